"""Rule tables. Every value here is a fixed value the results depend on.

The lists are plain Python so that they become literals inside one codegen stage
(no join, no row blow-up). All of them have a constant size; nothing here grows
with the data. Callers may pass their own tables to the operators that use them.
"""

# ---- fixed values: document fields -----------------------------------------
COMPARED_FIELDS = [
    "shipper", "consignee", "notify_party", "port_of_loading",
    "port_of_discharge", "container_count", "gross_weight_kg",
]
INFO_FIELDS = ["etd", "eta"]
ALL_FIELDS = COMPARED_FIELDS + INFO_FIELDS
NAME_FIELDS = ["shipper", "consignee", "notify_party"]
PORT_FIELDS = ["port_of_loading", "port_of_discharge"]

# ---- fixed values: label synonyms (regular expressions, case-insensitive) ---
LABELS = {
    "shipper": [
        r"shipper", r"shippers?", r"exporter", r"sender",
        r"shpr", r"principal", r"shipper\s*/\s*exporter",
    ],
    "consignee": [
        r"consignee", r"consinee", r"to the order of", r"receiver",
        r"cnee", r"buyer", r"consignee\s*/\s*receiver",
    ],
    "notify_party": [
        r"notify(?:\s+party)?", r"notified party", r"notify address",
        r"also notify", r"notif(?:y|ies)", r"notify\s*\([^)]*\)",
    ],
    "port_of_loading": [
        r"port of loading", r"load(?:ing)? port", r"\bPOL\b",
        r"port? of? load", r"place of receipt", r"\bPOR\b",
    ],
    "port_of_discharge": [
        r"port of discharge", r"discharge port", r"dest(?:ination)? port",
        r"\bPOD\b", r"final destination", r"place of delivery",
    ],
    "container_count": [
        r"container(?:\s+count|\s+total)?", r"total containers?",
        r"no\.? of containers?", r"containers?\s*:?",
        r"nr?\.? of containers?", r"quantity of containers?",
        r"ctnr", r"no\.? container",
    ],
    "gross_weight_kg": [
        r"gross\s+wt\.?\s*\(?(?:kgs?|kg)?\)?", r"gross weight", r"\bG\.?W\.?\b",
        r"total gross weight", r"gross mass", r"g\.?w\.?\s*\(?kgs?\)?",
    ],
    "etd": [
        r"etd", r"estimated time of departure", r"est\.? time of departure",
        r"expected time of departure", r"date of departure", r"departure date",
        r"etd\s*\(?", r"eta\s*/\s*etd",
    ],
    "eta": [
        r"eta", r"estimated time of arrival", r"est\.? time of arrival",
        r"expected time of arrival", r"date of arrival", r"arrival date",
        r"eta\s*\(?", r"etd\s*/\s*eta",
    ],
}
TRAILING_LABELS = (
    r"(?i)^(?:non[- ]negotiable|to the order of|notify(?:\s+party)?|port of loading"
    r"|load(?:ing)? port|pol|port of discharge|discharge port|pod"
    r"|final destination|total containers?|no\.? of containers?"
    r"|container(?:\s+count)?|gross\s+wt\.?\s*\(?(?:kgs?|kg)?\)?"
    r"|gross weight)\s*[:\-–]\s*"
)
PLACEHOLDER = (
    r"(?i)^(?:[_\-.–—\s]+|tba|tbc|tbd|n/?a|nil|none|xxx+|pending|to be advised|to follow)"
    r"(?:\s*(?:mt|mts|kgs?|kilogram|kilograms|ton|tons|t|x\s*\d+.*|[a-z']{1,3}))?$"
)
ADDRESS_CUT = (
    r"(?i)\s*(?:\||;|\bON BEHALF OF\b|\bO/B\b|\bC/O\b|,\s*(?:NO|NEW NO)\b|"
    r"\bTEL\b|\bFAX\b|\bEMAIL\b).*"
)
LEGAL_SUFFIXES = (
    r"\b(SDN\s*BHD|SDN|BH?D|PTE\s*LTD|PTE|LTD|LIMITED|LLC|L\s*L\s*C|FZE|FZ\s*LLC|"
    r"LLP|INC|INCORPORATED|PVT|PRIVATE|CO\s*LTD|CO\b|CORP|CORPORATION|GMBH|AG\b|"
    r"BV\b|NV\b|SA\b|SARL|SPA\b|PLC|PLC\b|TRADING|ENTERPRISE|ENTERPRISES|"
    r"INTERNATIONAL|INTL|GROUP|HOLDINGS|COMPANY|CO\s*KG|KG\b|AB\b|OY\b|AS\b|"
    r"PT\b|TBK|PLC)\b\.?"
)
CONTAINER_JOIN = r"(?i)\s*(?:\+|&|/|,|\band\b|\bplus\b)\s*"
CONTAINER_SPEC = r"(\d+)\s*[xX×]\s*(\d{2})"
WEIGHT_ANYWHERE = r"(?i)([\d][\d \.,]*(?:\.\d+)?)\s*(?:kg|kgs|kilograms?|tons?|t)?\b"
METRIC_TON = r"(?i)^\s*(?:metric\s*tons?|mts?|tonnes?|tons?|t)\b"
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
MONTH_NAMES = ["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST",
               "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER"]

# ---- fixed values: mail classification --------------------------------------
SPAM_DOMAIN_HINTS = [
    "crypto", "lottery", "casino", "viagra", "loan", "prize",
    "marketing", "promo", "newsletter",
    "secure-mailbox", "webmail-verify", "verify.co", "deals.biz", "logistics-deals",
    "parcel-track", "prize-claims", "secure-mail",
]
SPAM_SUBJECT_HINTS = [
    "win", "prize", "winner", "congrat", "lottery", "click here",
    "weird trick", "limited offer", "act now", "free ", "discount",
    "100%", "guarantee", "unsubscribe", "make money", "revenue",
]
SPAM_BODY_HINTS = [
    "click here", "unsubscribe", "limited time", "act now",
    "guaranteed", "100% free",
]
BL_REQUEST_HINTS = [
    "check", "verify", "confirm", "comparison", "compare", "review bl",
    "bl draft", "draft bl", "bl check", "attached are the si",
    "si and bl", "bl and si", "si & bl", "bl & si", "verify bl",
    "please check", "amend bl",
]
SI_REQUEST_HINTS = [
    "request si", "si needed", "need si", "si request", "submit si",
    "shipping instruction", "si required", "kindly issue si", "issue si",
    "provide si", "send si",
]
INVOICE_HINTS = [
    "invoice", "payment", "charges", "freight rate", "local charges",
    "billing", "debit note", "credit note", "outstanding", "payment terms",
    "remittance", "d&d charges", "demurrage", "telex release charge",
    "total freight", "mill d & d", "mill d&d",
]
INTERNAL_MARKERS = [
    "reminder", "rpa", "update summary", "berthing", "approval required",
    "time off", "billing process", "daily berthing", "miss connection",
    "outstanding bl", "list of outstanding",
]
SYSTEM_SUBJECTS = [
    "security alert", "2-step verification", "verification turned on",
    "finish setting up", "welcome to google", "google cloud platform",
    "project reinstated", "google ai studio",
]
SYSTEM_SENDER = "accounts.google.com"
SPAM_SUBJECT_WORD = r"\b(?:spam|phishing|malware|scam)\b"
SUBJECT_IS_SI = r"shipping[\s_-]?instruction|\bsi\b|submit\s+si|si\s+request"
SUBJECT_IS_BL = r"bill[\s_-]?of[\s_-]?lading|draft[\s_-]?b[\/_]?l|\bb[\/_]l\b|\bbl\b"
CATEGORIES = ["BL_COMPARISON", "SI_REQUEST", "INVOICE_QUERY", "GENERAL", "SPAM"]

DECLARED_MISSING = (
    r"(?i)(?:appear(?:s)? to have been dropped"
    r"|(?:is|are|was|were)\s+(?:still\s+)?missing"
    r"|not attached|failed to attach|didn'?t attach"
    r"|missing from (?:this|the) email"
    r"|no attachments? (?:were |was )?(?:included|provided))"
)
ASKED_TO_COMPARE = (
    r"(?i)compare(?:d)?\s+(?:the\s+)?(?:si|shipping instruction)\s+and\s+(?:the\s+)?(?:draft\s+)?(?:b/?l|bill of lading)"
    r"|check\s+(?:the\s+)?(?:draft\s+)?b/?l\s+against\s+the\s+si"
    r"|verify\s+(?:the\s+)?b/?l\s+matches\s+the\s+si"
)
DOCUMENT_REQUEST = (
    r"(?i)(?:please|pls|kindly)[^.]*?\b(?:assist\s+to\s+)?(?:send|provide|share|forward|issue)\b"
    r"[^.]*?\b(?:draft\s+)?(?:b/?l|si|shipping instruction|bill of lading)\b"
)

# ---- fixed values: document names and titles --------------------------------
DOC_SUFFIXES = [
    "txt", "pdf", "docx", "xlsx", "doc", "xls", "csv", "rtf",
    "png", "jpg", "jpeg", "tif", "tiff", "msg", "eml",
    "json", "jsonl", "ndjson", "xml",
    "odt", "ods", "odp", "ott", "ots", "otp",
    "pages", "numbers", "key",
    "edi", "edifact", "x12", "edifile", "ifcsum", "iftmin", "dxf", "dwg",
    "heic", "heif", "hif", "avif", "bmp", "webp",
]
SI_TOKENS = ["si"]
BL_TOKENS = ["bl", "bol", "hbl", "mbl"]
SI_PHRASES = ["shippinginstruction", "siform"]
BL_PHRASES = ["billoflading", "draftbl", "bldraft", "blcopy"]
INVOICE_NAME = r"(?i)(invoice|inv[._-]?\d|commercial[._ -]?inv)"
SYNTHETIC_MARK = ".frombody"
DOC_TITLES = [
    (r"SHIPPING\s+INSTRUCTION", "SI"),
    (r"BILL\s+OF\s+LADING\s+INSTRUCTION", "SI"),
    (r"SHIPPING\s+ORDER", "SI"),
    (r"\bS/?I\s+(?:FORM|NO)\b", "SI"),
    (r"BILL\s+OF\s+LADING", "BL"),
    (r"\bB/?L\s+(?:DRAFT|NO)\b", "BL"),
    (r"PACKING\s+LIST", "PACKING_LIST"),
    (r"CERTIFICATE\s+OF\s+ORIGIN", "CERTIFICATE_OF_ORIGIN"),
    (r"DELIVERY\s+ORDER", "DELIVERY_ORDER"),
    (r"BOOKING\s+(?:CONFIRMATION|NOTE)", "BOOKING_CONFIRMATION"),
    (r"COMMERCIAL\s+INVOICE", "INVOICE"),
]

# ---- fixed values: identifiers ----------------------------------------------
MAIL_REFERENCE = (
    r"(?i)\b(?:SDOC[-_ ]?)?[A-Z]{2,5}[-_ ]?\d{2,8}\b"
    r"|\b[A-Z]{2,8}[-_/][A-Z0-9]{2,8}\b"
)
# Stricter option: upper-case codes that contain a digit.
MAIL_REFERENCE_STRICT = r"\b[A-Z]{2,6}-\d{2,8}\b"
COUNTERPART_REFERENCE = r"\b[A-Z]{2,6}-\d{2,6}\b"
PAIR_TOKEN = r"(?i)([A-Za-z0-9]+-[A-Za-z0-9]+)_(SI|BL)[._]"
REFERENCE_LABEL = (
    r"(?i)\b(?:booking|b\s*/\s*l|bl|bill\s+of\s+lading|s\s*/\s*o|shipping\s+order|"
    r"shipment(?:\s+id)?|oc|order\s+confirmation|job|reference|ref|"
    r"file|shipment\s+no)\s*"
    r"(?:no|number|#|num|id|ref)?\s*"
    r"[:.#\-–]*\s*"
    r"([A-Z0-9][A-Z0-9]+(?:[-/_][A-Z0-9]+)*)"
)
NOT_A_REFERENCE = [
    "NO", "NUMBER", "REF", "REFERENCE", "TBA", "TBC", "TBD", "NA", "NIL", "NONE",
    "PENDING", "COPY", "DRAFT", "ORIGINAL", "PREPAID", "COLLECT", "FREIGHT",
]
CONTAINER_NUMBER = r"\b([A-Z]{3}[UJZ]\d{7})\b"
VESSEL = (
    r"(?i)\b(?:vessel(?:\s+name)?|ship\s+name|m\.?v\.?|m\.?s\.?c\.?)\s*[:.]?\s*"
    r"([A-Z][A-Z0-9 .'&-]{2,})"
)
VESSEL_TAIL = r"(?i)\s+(?:v\.?|voy|voyage)\b.*$"
VOYAGE = (
    r"(?i)\b(?:voyage|voy\.?|vessel\s+voyage|v\.)\s*"
    r"(?:no|number|#)?\s*[:.]?\s*([A-Z0-9][A-Z0-9-]+)\b"
)
INVOICE_NUMBER = r"(?i)invoice\s*(?:no|number|#|num)\s*[:.#-]?\s*([A-Z0-9][A-Z0-9/_-]{2,})"
INVOICE_TOTAL = (
    r"(?i)(?:grand\s+total|total\s+amount|amount\s+due|total)\s*"
    # The amount stands on the label's line, or below it: with any words where the label ends its line, else with a currency code.
    r"(?:[^0-9\n]*|[^\w\n]*(?:[A-Z]{3}\b[^\w\n]*)?\n[^0-9\n]*|[^0-9\n]*\n[^\w\n]*(?:(?:[A-Z]{3}|US|RM)[^\w\n]*)?)"
    r"([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
)
CURRENCY = r"\b(USD|EUR|MYR|GBP|SGD|CNY|AUD|JPY)\b"

# ---- fixed values: subjects and forwarded headers ---------------------------
REPLY_PREFIX = r"(?i)^(?:\[?(?:fwd?|re|fw|aw|wg|rv|res|转发|回復|回复)\]?[\s:：\-_]*)+"
AUDIT_SUFFIX = (
    r"(?i)\s*-\s*(?:Document Verification Complete|B/L Document Amendment Required"
    r"|Document Ingestion Rejected|Discrepancy Notice).*$"
)
ORIGINAL_SENDER = (
    r"(?i)(?:(?:From|发件人|De|Von|De\s+la\s+part\s+de)[\s:：]+(?:[^\n<]*<)?"
    r"([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)>?)"
)

# ---- fixed values: JSON, EDI ------------------------------------------------
JSON_IGNORED_SEGMENTS = [
    "data", "payload", "content", "contents", "body", "value", "values",
    "fields", "document", "doc", "root", "items", "records", "rows",
]
EDI_SUFFIXES = [".edi", ".edifact", ".x12", ".edifile", ".ifcsum", ".iftmin"]
EDIFACT_HEADS = ["UNA", "UNB", "UNG", "UNH"]
UNIT_TO_KG = {
    "KGM": 1.0, "KG": 1.0, "KGS": 1.0,
    "GRM": 0.001, "G": 0.001,
    "TNE": 1000.0, "TON": 1000.0, "T": 1000.0,
    "LBR": 0.45359237, "LB": 0.45359237, "LBS": 0.45359237,
    "STN": 907.18474,
}
WEIGHT_DIMENSIONS = ["AAD", "AAJ", "AAK", "G", "GROSS"]
EDIFACT_PARTIES = {"SH": "Shipper", "CN": "Consignee", "NI": "Notify Party",
                   "N1": "Notify Party", "CZ": "Notify Party"}
EDIFACT_PLACES = {"9": "Port of Loading", "11": "Port of Discharge", "7": "Port of Discharge",
                  "8": "Port of Discharge", "12": "Port of Discharge", "88": "Port of Loading"}
EDI_DATES = {"133": "ETD", "178": "ETA", "186": "ETA"}
X12_PARTIES = {"SH": "Shipper", "CN": "Consignee", "NI": "Notify Party", "N1": "Notify Party"}
X12_PORTS = {"1": "Port of Loading", "2": "Port of Discharge"}

# ---- fixed values: attachment safety ------------------------------------------
DANGEROUS_EXTENSIONS = [
    "exe", "dll", "bat", "cmd", "vbs", "vbe", "js", "jse",
    "wsf", "wsh", "ps1", "psm1", "scr", "pif", "hta", "cpl",
    "jar", "com", "sh", "bash", "bin",
]
EXECUTABLE_LABELS = [e for e in DANGEROUS_EXTENSIONS if e not in ("com", "bin")]
MAX_ATTACHMENT_BYTES = 30 * 1024 * 1024
MAX_MEMBERS = 25
MAX_MEMBER_BYTES = 10 * 1024 * 1024
MAX_LEVELS = 2  # container layers that are opened
# (suffixes, leading bytes in hex, what the suffix claims)
CONTAINER_HEADERS = [
    (["zip"], ["504B0304", "504B0506", "504B0708"], "ZIP archive"),
    (["odt", "ods", "odp", "ott", "ots", "otp"], ["504B0304"], "OpenDocument document"),
    (["pages", "numbers", "key"], ["504B0304"], "iWork package"),
    (["7z"], ["377ABCAF271C"], "7-Zip archive"),
    (["rar"], ["526172211A07"], "RAR archive"),
    (["gz", "tgz"], ["1F8B"], "gzip stream"),
    (["msg"], ["D0CF11E0A1B11AE1"], "Outlook message"),
    (["rtf"], ["7B5C727466"], "RTF document"),
    (["dwg"], ["41433130"], "DWG drawing"),
]
BOUNCE_SUBJECTS = [
    "delivery status notification", "undelivered mail returned", "returned mail",
    "mail delivery failed", "delivery failure", "failure notice", "undeliverable", "bounced mail",
]
STAGE_REFERENCE = r"(?i)Ref\s*#\s*([A-Za-z0-9._:-]+)"
REVIEW_LABELS = {
    "missing_attachment": "Missing SI or BL attachment",
    "wrong_doc_type": "Attached document is the wrong type",
    "unreadable": "Attachment unreadable — needs OCR / vision / human",
    "missing_value": "Field value missing on one side (undecidable)",
}
REVIEW_ORDER = ["missing_attachment", "wrong_doc_type", "unreadable", "missing_value", "unknown"]
