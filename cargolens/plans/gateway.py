"""Gates, policies, replies and delivery state."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..operators import compare as K, extract as X, gates as G, replies as R
from . import duck as D
from .extraction import pairs
from .mails import all_mails, verdicts
from .registry import query, step

# Trust lists and policies come from configuration; a handful of rows.
SOURCES = "SELECT 'docs@hub.example' AS source UNION ALL SELECT ' Ops@Example.com ' UNION ALL SELECT 'OPS' UNION ALL SELECT 'docs@hub.example'"
DOMAINS = "SELECT 'hub.example' AS domain UNION ALL SELECT 'example.com'"
POLICIES = "SELECT 'ingest' AS scope, 'OPS' AS mailbox, 'auto' AS mode UNION ALL SELECT 'ingest', 'DOCS', 'manual' UNION ALL SELECT 'ingest', 'BOOKING', 'off'"
step("ox_sources", f"SELECT DISTINCT lower(trim(source)) AS source FROM ({SOURCES}) x")
step("ox_domains", DOMAINS)
step("ox_policy", f"SELECT * FROM ({POLICIES}) x WHERE mode IN ('auto', 'manual')")


@query("gte1_trusted_sources", "SELECT source FROM ox_sources UNION SELECT lower(trim(sender)) FROM fx_staged WHERE status = 'APPROVED'")
def gte1(t):
    return G.trusted_sources(t.sql(SOURCES), t.view("fx_staged").filter("status = 'APPROVED'").select("sender"))


_addr = lambda e: f"lower(trim(coalesce(nullif(regexp_extract({e}, '<([^>]+)>', 1), ''), {e})))"
step("ox_trust", f"""SELECT email_id, body, subject, category, s IN (SELECT source FROM ox_sources) AS s_ok, c IN (SELECT source FROM ox_sources) AS c_ok,
  contains(s, '@') AND split_part(s, '@', -1) IN (SELECT domain FROM ox_domains) AS sd_ok, contains(c, '@') AND split_part(c, '@', -1) IN (SELECT domain FROM ox_domains) AS cd_ok, s = '' AND length(email_id) % 2 = 0 AS m_ok, s, c
  FROM (SELECT m.email_id, body, subject, k.category, CASE WHEN subject = '' THEN '' ELSE {_addr('sender')} END AS s, coalesce(lower(nullif(regexp_extract(body, {D.q(rules.ORIGINAL_SENDER)}, 1), '')), '') AS c
        FROM fx_all_mails m JOIN ox_class k ON k.email_id = m.email_id) x""")


def trusted(t):
    # Mails without a subject came through a channel and have no sender; every other mailbox is a trusted one.
    m = all_mails(t).withColumn("client", T.original_sender(F.col("body"))).withColumn("mailbox", F.when(F.length("email_id") % 2 == 0, "ops").otherwise("sales"))
    m = m.withColumn("sender", F.when(F.col("subject") == "", "").otherwise(F.col("sender")))
    return G.trust(m, G.trusted_sources(t.sql(SOURCES)), t.sql(DOMAINS))


@query("gte2_source_trust", """SELECT email_id, s_ok OR c_ok OR sd_ok OR cd_ok OR m_ok AS trusted, CASE WHEN s_ok THEN 'Sender ''' || s || ''' is verified' WHEN c_ok THEN 'Original client ''' || c || ''' is verified'
  WHEN sd_ok THEN 'Domain ''@' || split_part(s, '@', -1) || ''' is authorized' WHEN cd_ok THEN 'Domain ''@' || split_part(c, '@', -1) || ''' is authorized' WHEN m_ok THEN 'Internal channel ''ops'' is verified' ELSE 'Sender ''' || coalesce(nullif(s, ''), nullif(c, ''), 'unknown') || ''' is not registered' END AS trust_reason FROM ox_trust""")
def gte2(t):
    return trusted(t).select("email_id", "trusted", "trust_reason")


@query("ext19_original_sender", f"SELECT email_id, nullif(regexp_extract(body, {D.q(rules.ORIGINAL_SENDER)}, 1), '') AS client FROM fx_all_mails")
def ext19(t):
    return all_mails(t).select("email_id", T.original_sender(F.col("body")).alias("client"))


@query("ext20_clean_subject", f"""SELECT email_id, coalesce(nullif(trim(regexp_replace(trim(regexp_replace(trim(subject), {D.q(rules.AUDIT_SUFFIX)}, '')), {D.q(rules.REPLY_PREFIX)}, '')), ''), trim(subject)) AS subject FROM fx_all_mails""")
def ext20(t):
    return all_mails(t).select("email_id", T.clean_subject(F.col("subject")).alias("subject"))


@query("nrm14_addresses", f"SELECT email_id, {_addr('sender')} AS address, CASE WHEN contains(sender, '@') THEN split_part({_addr('sender')}, '@', -1) END AS domain FROM fx_all_mails")
def nrm14(t):
    return all_mails(t).select("email_id", T.mail_address(F.col("sender")).alias("address"), T.mail_domain(F.col("sender")).alias("domain"))


@query("nrm15_message_ids", "SELECT dispatch_id, nullif(trim(message_id, '<>'), '') AS message_id FROM fx_dispatches")
def nrm15(t):
    return t.view("fx_dispatches").select("dispatch_id", T.bare_message_id(F.col("message_id")).alias("message_id"))


# ---------------------------------------------------------------------- safety
_suf = "lower(regexp_extract(filename, '^.+[.]([^.]+)$', 1))"
_claims = " ".join(f"WHEN {_suf} IN ({','.join(D.q(x) for x in s)}) THEN CASE WHEN NOT regexp_matches(head, '^({'|'.join(m)})') THEN '{label}' END" for s, m, label in rules.CONTAINER_HEADERS)
_claim = f"""CASE {_claims} WHEN {_suf} = 'tar' THEN CASE WHEN substr(head, 515, 10) <> '7573746172' THEN 'tar archive' END
  WHEN {_suf} IN ('heic','heif','hif','avif') THEN CASE WHEN substr(head, 9, 8) <> '66747970' THEN 'HEIF image' END
  WHEN {_suf} = 'eml' THEN CASE WHEN NOT regexp_matches(decode(unhex(head)), '(?m)^[A-Za-z][A-Za-z0-9-]{{1,40}}:') THEN 'MIME message' END END"""
_claim = _claim.replace("decode(unhex(head))", "CASE WHEN head LIKE 'CA%' OR head LIKE '7F%' OR head LIKE '4D5A9%' OR head LIKE '000%' THEN '' ELSE decode(unhex(head)) END")


@query("gte4_header_claims", f"SELECT id, {_claim} AS mismatch FROM fx_manifest")
def gte4(t):
    return t.view("fx_manifest").select("id", G.header_mismatch(G.suffix_of(F.col("filename")), F.col("head")).alias("mismatch"))


@query("gte3_file_safety", f"""SELECT id, CASE WHEN filename = '' THEN 'Empty filename' WHEN size > 31457280 THEN 'Attachment exceeds maximum allowed size'
  WHEN len(string_split(filename, '.')) >= 3 AND lower(string_split(filename, '.')[-2]) IN ({','.join(D.q(x) for x in rules.EXECUTABLE_LABELS)}) THEN 'Double-extension spoofing detected: ''' || filename || ''''
  WHEN {_suf} IN ({','.join(D.q(x) for x in rules.DANGEROUS_EXTENSIONS)}) THEN 'Executable or script extension blocked: ''.' || {_suf} || ''''
  WHEN regexp_matches(head, '^(4D5A|7F454C46|CAFEBABE)') THEN 'Dangerous executable header: ''' || filename || ''''
  WHEN {_suf} = 'pdf' AND NOT contains(head, '255044462D') THEN 'Spoofed or corrupted PDF header: ''' || filename || ''''
  WHEN {_suf} IN ('docx','xlsx') AND NOT starts_with(head, '504B0304') THEN 'Spoofed or corrupted Office OpenXML container: ''' || filename || ''''
  WHEN ({_claim}) IS NOT NULL THEN 'Spoofed or corrupted ' || ({_claim}) || ' header' ELSE 'SAFE' END AS verdict FROM fx_manifest""")
def gte3(t):
    return t.view("fx_manifest").select("id", G.file_safety(F.col("filename"), F.col("size"), F.col("head")).alias("verdict"))


@query("gte5_encoded_size", "SELECT doc_id, (length(text) // 4) * 3 > 3000 AS too_large FROM documents")
def gte5(t):
    return t("documents").select("doc_id", G.encoded_too_large(F.col("text"), 3000).alias("too_large"))


step("ox_member", r"""SELECT *, CASE WHEN NOT (regexp_matches(name, '(^|/)\.\.(/|$)|^/|/$') OR starts_with(regexp_extract(name, '([^/]+)$', 1), '.')) THEN regexp_extract(name, '([^/]+)$', 1) END AS base FROM fx_members""")


@query("gte7_member_names", "SELECT mail, pos, base FROM ox_member")
def gte7(t):
    return t.view("fx_members").select("mail", "pos", G.member_name(F.col("name")).alias("base"))


step("ox_numbered", "SELECT *, row_number() OVER (PARTITION BY mail ORDER BY pos, name, size, safe) AS n FROM ox_member")
step("ox_fold", """SELECT DISTINCT mail, CAST(0 AS BIGINT) AS n, CAST(31457280 AS BIGINT) AS room, CAST([] AS VARCHAR[]) AS taken FROM fx_members
  UNION ALL SELECT mail, n, CASE WHEN ok THEN room - size ELSE room END, CASE WHEN ok THEN list_append(taken, base) ELSE taken END FROM (
    SELECT m.mail, m.n, f.room, f.taken, m.base, m.size, coalesce(m.base IS NOT NULL AND m.safe AND m.size <= 10485760 AND m.size <= f.room AND len(f.taken) < 25 AND NOT list_contains(f.taken, m.base), false) AS ok
    FROM ox_fold f JOIN ox_numbered m ON m.mail = f.mail AND m.n = f.n + 1) x""")


@query("gte6_member_admission", "SELECT f.mail, array_to_string(arg_max(taken, n), ',') AS taken, any_value(m.c) - len(arg_max(taken, n)) AS refused FROM ox_fold f JOIN (SELECT mail, count(*) AS c FROM fx_members GROUP BY mail) m ON m.mail = f.mail GROUP BY f.mail")
def gte6(t):
    # A manifest belongs to one mail; here an order's few lines stand for it.
    m = t.view("fx_members").groupBy("mail").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "size", "safe"))).alias("members"))
    return G.admit_members(m, rules.MAX_MEMBERS, rules.MAX_MEMBER_BYTES, rules.MAX_ATTACHMENT_BYTES).select("mail", F.array_join("taken", ",").alias("taken"), F.size("refused").cast("bigint").alias("refused"))


step("ox_tree", """SELECT mail, pos, parent, name, size, container, safe, [pos] AS path, 1 AS layer FROM fx_nested WHERE parent IS NULL
  UNION ALL SELECT c.mail, c.pos, c.parent, c.name, c.size, c.container, c.safe, list_append(t.path, c.pos), t.layer + 1 FROM ox_tree t JOIN fx_nested c ON c.mail = t.mail AND c.parent = t.pos""")
step("ox_preorder", r"""SELECT *, row_number() OVER (PARTITION BY mail ORDER BY path) AS n, CASE WHEN NOT (regexp_matches(name, '(^|/)\.\.(/|$)|^/|/$') OR starts_with(regexp_extract(name, '([^/]+)$', 1), '.')) THEN regexp_extract(name, '([^/]+)$', 1) END AS base
  FROM (SELECT mail, pos, parent, name, size, container, safe, path, layer FROM ox_tree) x""".replace(chr(92) * 2, chr(92)))
step("ox_nested_fold", """SELECT DISTINCT mail, CAST(0 AS BIGINT) AS n, CAST(31457280 AS BIGINT) AS room, CAST([] AS VARCHAR[]) AS taken, CAST([] AS INTEGER[]) AS opened FROM fx_nested
  UNION ALL SELECT mail, n, CASE WHEN ok THEN room - size ELSE room END, CASE WHEN ok THEN list_append(taken, seat) ELSE taken END, CASE WHEN ok AND container THEN list_append(opened, pos) ELSE opened END FROM (
    SELECT m.mail, m.n, m.pos, m.container, f.room, f.taken, f.opened, m.size, coalesce(m.parent::VARCHAR, '') || '/' || m.base AS seat,
      coalesce(m.layer <= 2 AND (m.parent IS NULL OR list_contains(f.opened, m.parent)) AND m.base IS NOT NULL AND m.safe AND m.size <= 10485760 AND m.size <= f.room AND len(f.taken) < 25
        AND NOT list_contains(f.taken, coalesce(m.parent::VARCHAR, '') || '/' || m.base), false) AS ok
    FROM ox_nested_fold f JOIN ox_preorder m ON m.mail = f.mail AND m.n = f.n + 1) x""")


# A member whose container the manifest lacks is in no tree; it is refused for its depth.
@query("gte6n_nested_admission", """SELECT f.mail, array_to_string(arg_max(taken, n), ',') AS taken, any_value(m.c) - len(arg_max(taken, n)) AS refused
  FROM ox_nested_fold f JOIN (SELECT mail, count(*) AS c FROM fx_nested GROUP BY mail) m ON m.mail = f.mail GROUP BY f.mail""")
def gte6n(t):
    done = G.admit_nested(G.walked_members(t.view("fx_nested"), rules.MAX_LEVELS), rules.MAX_LEVELS, rules.MAX_MEMBERS, rules.MAX_MEMBER_BYTES, rules.MAX_ATTACHMENT_BYTES)
    seat = lambda m: F.concat(F.coalesce(F.get(m["path"], F.size(m["path"]) - 2).cast("string"), F.lit("")), F.lit("/"), m["name"])
    return done.select("mail", F.array_join(F.transform("taken", seat), ",").alias("taken"), F.size("refused").cast("bigint").alias("refused"))


step("ox_stage", "SELECT email_id, category, (s_ok OR c_ok OR sd_ok OR cd_ok OR m_ok) AS trusted, length(subject) % 5 = 0 AS unsafe FROM ox_trust")


@query("gte8_staging_decision", """SELECT email_id, CASE WHEN NOT trusted THEN 'UNTRUSTED_SOURCE' ELSE category END AS category, CASE WHEN NOT trusted OR unsafe THEN 'BLOCKED' ELSE 'CLEAN' END AS security_status,
  CASE WHEN NOT trusted OR unsafe OR category = 'SPAM' THEN 'QUARANTINED' ELSE 'APPROVED' END AS stage_status FROM ox_stage""")
def gte8(t):
    from ..operators import classify as C
    m = C.classify(trusted(t)).withColumn("unsafe", F.length("subject") % 5 == 0)
    return G.staging(m).select("email_id", "category", "security_status", "stage_status")


def policies(t):
    return G.valid_policies(t.sql(POLICIES))


@query("gte9_ingest_mode", "SELECT s.id, coalesce(p.mode, 'auto') AS mode FROM fx_staged s LEFT JOIN ox_policy p ON p.mailbox = s.source_mailbox")
def gte9(t):
    return G.effective_mode(t.view("fx_staged"), policies(t), "auto").select("id", "mode")


step("ox_item", "SELECT s.id, s.source_mailbox, CASE CAST(s.id % 5 AS INT) WHEN 0 THEN 'AUTO' WHEN 1 THEN 'manual' WHEN 2 THEN NULL ELSE 'INHERIT' END AS o FROM fx_staged s")


@query("gte10_disposition", "SELECT i.id, coalesce(CASE WHEN o <> 'INHERIT' THEN lower(o) END, p.mode, 'manual') AS disposition FROM ox_item i LEFT JOIN ox_policy p ON p.mailbox = i.source_mailbox")
def gte10(t):
    i = F.col("id") % 5
    s = t.view("fx_staged").withColumn("disposition_override", F.when(i == 0, "AUTO").when(i == 1, "manual").when(i == 2, F.lit(None)).otherwise("INHERIT"))
    return G.effective_disposition(s, policies(t), "manual").select("id", "disposition")


@query("gte11_bulk_approval", "SELECT id, CASE WHEN security_status = 'BLOCKED' THEN 'skipped_blocked' ELSE 'approved' END AS outcome FROM fx_staged WHERE status IN ('STAGED', 'QUARANTINED') AND source_mailbox = 'OPS'")
def gte11(t):
    return G.bulk_approve(t.view("fx_staged"), "OPS", True).select("id", "outcome")


@query("gte12_policy_reapplied", "SELECT s.id FROM fx_staged s LEFT JOIN ox_policy p ON p.mailbox = s.source_mailbox WHERE s.status = 'STAGED' AND s.security_status <> 'BLOCKED' AND coalesce(p.mode, 'manual') = 'auto'")
def gte12(t):
    return G.reapply_policy(t.view("fx_staged"), policies(t), "manual").select("id")


@query("gte13_policy_cleaning", "SELECT source_mailbox, mode FROM fx_policies WHERE mode = 'auto' OR mode = 'manual'")
def gte13(t):
    return G.valid_policies(t.view("fx_policies"))


step("ox_change", "SELECT event_id AS change_id, 'email_' || CAST(user_id AS VARCHAR) AS email_id, CASE event_type WHEN 'view' THEN 'AUTO' WHEN 'click' THEN 'HOLD' ELSE 'IGNORE' END AS assignment, CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS note, ts AS updated_at FROM events")


def assignments(t):
    c = t("events").select(F.col("event_id").alias("change_id"), F.concat(F.lit("email_"), F.col("user_id").cast("string")).alias("email_id"),
                           F.when(F.col("event_type") == "view", "AUTO").when(F.col("event_type") == "click", "HOLD").otherwise("IGNORE").alias("assignment"),
                           F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("note"), F.col("ts").alias("updated_at"))
    return G.latest_assignments(t.mails, c)


step("ox_assign", "SELECT m.email_id, coalesce(arg_max(c.assignment, (c.updated_at, c.change_id)), 'HOLD') AS assignment, arg_max(c.note, (c.updated_at, c.change_id)) FILTER (WHERE c.note IS NOT NULL) AS note FROM fx_emails m LEFT JOIN ox_change c ON c.email_id = m.email_id GROUP BY m.email_id")


@query("gte14_assignments", "SELECT * FROM ox_assign")
def gte14(t):
    return assignments(t)


@query("gte15_run_eligibility", """SELECT r.email_id, m.email_id IS NOT NULL AND coalesce(a.assignment, '') <> 'IGNORE' AS runs, CASE WHEN m.email_id IS NULL THEN 'not in this workspace' WHEN a.assignment = 'IGNORE' THEN 'assigned IGNORE' END AS reason
  FROM (SELECT DISTINCT 'email_' || CAST(event_id % 2000 AS VARCHAR) AS email_id FROM events) r LEFT JOIN fx_emails m ON m.email_id = r.email_id LEFT JOIN ox_assign a ON a.email_id = r.email_id""")
def gte15(t):
    req = t("events").select(F.concat(F.lit("email_"), (F.col("event_id") % 2000).cast("string")).alias("email_id"))
    return G.run_eligibility(req, t.mails, assignments(t))


@query("gte16_staging_status", "SELECT s.id, CASE WHEN security_status = 'BLOCKED' OR category = 'SPAM' THEN 'QUARANTINED' WHEN coalesce(p.mode, 'manual') = 'auto' THEN 'AUTO_INGESTED' ELSE 'STAGED' END AS new_status FROM fx_staged s LEFT JOIN ox_policy p ON p.mailbox = s.source_mailbox")
def gte16(t):
    s = G.effective_mode(t.view("fx_staged"), policies(t), "manual")
    return s.select("id", G.staging_status(F.col("security_status"), F.col("category"), F.col("mode")).alias("new_status"))


# --------------------------------------------------------------------- replies
step("ox_linked", "SELECT d.*, coalesce(d.email_id, m.email_id) AS linked FROM fx_dispatches d LEFT JOIN fx_emails m ON m.email_id = substr(d.stage_id, 5)")


@query("rpy1_latest_dispatch", "SELECT linked AS email_id, max(dispatch_id) AS dispatch_id FROM ox_linked WHERE linked IS NOT NULL GROUP BY linked")
def rpy1(t):
    return R.latest_dispatch(t.view("fx_dispatches"), t.mails).select("email_id", "dispatch_id")


step("ox_inbox", """SELECT m.email_id, r.category, r.status, CASE WHEN r.reviewed THEN 'human' ELSE 'rule' END AS decided_by, d.dispatch_id IS NOT NULL AS has_dispatch,
  CASE WHEN d.delivery IN ('SENT','SENT_SMTP') THEN 'sent' WHEN d.delivery IN ('FAILED','ERROR') THEN 'failed' WHEN d.delivery = 'SIMULATED' THEN 'simulated' WHEN d.delivery IS NOT NULL THEN 'unknown' WHEN r.status IN ('MISMATCH','NEEDS_REVIEW') THEN 'awaiting' ELSE 'none' END AS reply_state
  FROM fx_emails m LEFT JOIN fx_reports r ON r.email_id = m.email_id LEFT JOIN (SELECT l.* FROM ox_linked l JOIN fx_sent s ON s.dispatch_id = l.dispatch_id) d ON d.linked = m.email_id""")


def inbox(t):
    return R.enriched_inbox(t.mails, t.view("fx_reports"), t.view("fx_sent"))


@query("rpy2_reply_state", "SELECT email_id, reply_state FROM ox_inbox")
def rpy2(t):
    return inbox(t).select("email_id", "reply_state")


@query("rpy3_enriched_inbox", "SELECT * FROM ox_inbox")
def rpy3(t):
    return inbox(t).select("email_id", "category", "status", "decided_by", "has_dispatch", "reply_state")


@query("rpy4_receipts", """SELECT email_id, CASE WHEN status IN ('MISMATCH','NEEDS_REVIEW') THEN 'REJECTED' ELSE 'VERIFIED' END AS decision,
  CASE WHEN status IN ('MISMATCH','NEEDS_REVIEW') THEN 'B/L to be amended - Ref #' ELSE 'Documents verified - Ref #' END || email_id AS receipt_subject,
  CASE WHEN status IN ('MISMATCH','NEEDS_REVIEW') THEN coalesce(review_reason, 'The SI and the B/L do not agree.') END AS issue FROM fx_reports""")
def rpy4(t):
    return R.receipt(t.view("fx_reports")).select("email_id", "decision", "receipt_subject", "issue")


@query("rpy5_audit_data", """SELECT s.email_id, coalesce(s.port_of_loading, b.port_of_loading, 'Counterpart Verified') AS pol, coalesce(s.port_of_discharge, b.port_of_discharge, 'Counterpart Verified') AS pod,
  coalesce(printf('%,.1f', coalesce(s.gross_weight_kg, b.gross_weight_kg)) || ' KGS', 'Reconciled') AS weight, coalesce(CAST(coalesce(s.container_count, b.container_count) AS VARCHAR) || ' Unit(s)', 'Verified') AS containers,
  (SELECT count(*) FROM ox_pair_long p WHERE p.email_id = s.email_id) AS ledger_lines
  FROM ox_fields s JOIN ox_fields b ON b.email_id = s.email_id AND b.doc_type = 'BL' WHERE s.doc_type = 'SI'""".replace("printf('%,.1f', coalesce(s.gross_weight_kg, b.gross_weight_kg))", "format('{:,.1f}', coalesce(s.gross_weight_kg, b.gross_weight_kg))"))
def rpy5(t):
    a = R.audit_data(pairs(t))
    return a.select("email_id", "pol", "pod", "weight", "containers", F.size(F.split("ledger", "\n")).cast("bigint").alias("ledger_lines"))


@query("rpy6_reply_suppression", """SELECT s.email_id, CASE WHEN s.sender = '' THEN 'No sender email address' WHEN security_status <> 'CLEAN' OR s.status = 'QUARANTINED' THEN 'Security suppression' WHEN s.category = 'SPAM' THEN 'Spam suppression'
  WHEN s.category <> 'BL_COMPARISON' THEN 'Category suppression' WHEN e.attachments_csv = '' THEN 'Content suppression' WHEN r.status IS NULL THEN 'Pipeline suppression' WHEN r.status NOT IN ('OK','MISMATCH','NEEDS_REVIEW') THEN 'Status suppression' END AS suppression
  FROM fx_staged s JOIN fx_emails e ON e.email_id = s.email_id LEFT JOIN fx_reports r ON r.email_id = s.email_id""")
def rpy6(t):
    s = t.view("fx_staged").withColumnRenamed("status", "stage_status").join(t.mails.select("email_id", "attachments"), "email_id")
    return R.reply_suppression(s.join(t.view("fx_reports").select("email_id", "status"), "email_id", "left")).select("email_id", "suppression")


@query("rpy7_reply_fingerprint", "SELECT email_id, sha256(concat_ws(chr(31), email_id, sender, 'OPS', subject, body)) AS fingerprint FROM fx_emails")
def rpy7(t):
    c = F.col
    return t.mails.select("email_id", R.fingerprint(c("email_id"), c("sender"), F.lit("OPS"), c("subject"), c("body")).alias("fingerprint"))


step("ox_appr", """SELECT event_id AS id, 'email_' || CAST(user_id AS VARCHAR) AS email_id, props AS fingerprint, ts AS created_at, CASE WHEN event_id % 6 = 0 THEN 'USED' ELSE 'APPROVED' END AS st,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('signup', 'error')""")


@query("rpy8_approval_validity", """SELECT r.id AS approval_id, CASE WHEN a.id IS NULL OR a.fingerprint <> r.f OR a.st <> 'APPROVED' OR a.n > 1 THEN 'STALE' WHEN r.now - a.created_at > INTERVAL 24 HOURS THEN 'EXPIRED' ELSE 'VALID' END AS outcome
  FROM (SELECT id, email_id, CASE WHEN id % 7 = 0 THEN 'x' ELSE fingerprint END AS f, created_at + CASE WHEN id % 3 = 0 THEN INTERVAL 30 HOURS ELSE INTERVAL 2 HOURS END AS now FROM ox_appr) r LEFT JOIN ox_appr a ON a.id = r.id AND a.email_id = r.email_id""")
def rpy8(t):
    a = t("events").filter("event_type IN ('signup', 'error')").select(
        F.col("event_id").alias("id"), F.concat(F.lit("email_"), F.col("user_id").cast("string")).alias("email_id"), F.col("props").alias("fingerprint"),
        F.col("ts").alias("created_at"), F.when(F.col("event_id") % 6 == 0, "USED").otherwise("APPROVED").alias("status"))
    late = F.when(F.col("id") % 3 == 0, F.expr("INTERVAL 30 HOURS")).otherwise(F.expr("INTERVAL 2 HOURS"))
    r = a.select(F.col("id").alias("approval_id"), "email_id", F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("fingerprint")).alias("fingerprint"), (F.col("created_at") + late).alias("now"))
    return R.approval_validity(r, a).select("approval_id", "outcome")


step("ox_notice", "SELECT event_id AS notice_id, 'STG-' || CAST(user_id AS VARCHAR) AS stage_id, event_type AS recipient, props AS subject FROM events")


@query("rpy9_new_notices", "SELECT min(notice_id) AS notice_id, stage_id, recipient, subject FROM ox_notice n WHERE NOT EXISTS (SELECT 1 FROM ox_notice s WHERE s.notice_id % 5 = 0 AND s.stage_id = n.stage_id AND s.recipient = n.recipient AND s.subject = n.subject) GROUP BY ALL")
def rpy9(t):
    n = t("events").select(F.col("event_id").alias("notice_id"), F.concat(F.lit("STG-"), F.col("user_id").cast("string")).alias("stage_id"), F.col("event_type").alias("recipient"), F.col("props").alias("subject"))
    return R.new_notices(n, n.filter("notice_id % 5 = 0"))


@query("rpy10_bounces", f"""SELECT event_id, (event_id % 4 = 0) OR event_id % 5 = 0 OR {D.any_of('lower(subject)', rules.BOUNCE_SUBJECTS)} AS bounce FROM (SELECT event_id, subject FROM fx_bounces UNION ALL SELECT k, subject FROM fx_emails) x""")
def rpy10(t):
    n = t.view("fx_bounces").select("event_id", "subject").unionByName(t.view("fx_emails").select(F.col("k").alias("event_id"), "subject"))
    ct = F.when(F.col("event_id") % 4 == 0, "multipart/report; report-type=delivery-status").otherwise("text/plain")
    who = F.when(F.col("event_id") % 5 == 0, "Mailer-Daemon <x@y>").otherwise("a@b.c")
    return n.select("event_id", R.is_bounce(ct, who, F.col("subject")).alias("bounce"))


@query("rpy11_status_blocks", "SELECT event_id, CASE WHEN original_message_id IS NOT NULL THEN '<' || original_message_id || '>' END AS original_message_id, recipient, action, status_code, 'smtp; 550 no: user' AS diagnostic FROM fx_bounces")
def rpy11(t):
    return t.view("fx_notices").select("event_id", R.status_block(F.col("block")).alias("b")).select("event_id", "b.original_message_id", "b.recipient", "b.action", "b.status_code", "b.diagnostic")


step("ox_event", """SELECT *, CASE WHEN action = 'delivered' THEN 'DELIVERED' WHEN action = 'delayed' OR starts_with(status_code, '4.') THEN 'DELAYED' WHEN action IN ('failed','failure') OR starts_with(status_code, '5.') THEN 'BOUNCED'
  WHEN regexp_matches(lower(subject), 'failure|undelivered|returned mail|bounce') THEN 'BOUNCED' ELSE 'FAILED' END AS event_type FROM fx_bounces""")


def events(t):
    e = t.view("fx_bounces").withColumn("event_type", R.event_type(F.col("action"), F.col("status_code"), F.col("subject")))
    return e.withColumn("message_ids", F.array_compact(F.array("original_message_id"))).withColumn("subjects", F.array("subject"))


@query("rpy12_event_types", "SELECT event_id, event_type FROM ox_event")
def rpy12(t):
    return events(t).select("event_id", "event_type")


step("ox_matched", """SELECT e.*, coalesce(a.dispatch_id, b.dispatch_id, c.dispatch_id) AS dispatch_id, CASE WHEN a.dispatch_id IS NOT NULL THEN 1 WHEN b.dispatch_id IS NOT NULL THEN 2 WHEN c.dispatch_id IS NOT NULL THEN 3 END AS matched_by FROM ox_event e
  LEFT JOIN (SELECT trim(message_id, '<>') AS m, max(dispatch_id) AS dispatch_id FROM fx_dispatches GROUP BY ALL) a ON a.m = e.original_message_id
  LEFT JOIN (SELECT stage_id, max(dispatch_id) AS dispatch_id FROM fx_dispatches GROUP BY ALL) b ON b.stage_id = nullif(regexp_extract(e.subject, 'Ref\\s*#\\s*([A-Za-z0-9._:-]+)', 1), '')
  LEFT JOIN (SELECT recipient, max(dispatch_id) AS dispatch_id FROM fx_dispatches GROUP BY ALL) c ON c.recipient = e.recipient""")


@query("rpy13_dispatch_match", "SELECT event_id, dispatch_id, matched_by FROM ox_matched")
def rpy13(t):
    return R.match_dispatch(events(t), t.view("fx_dispatches").drop("email_id")).select("event_id", "dispatch_id", "matched_by")


@query("rpy14_distinct_events", "SELECT min(event_id) AS event_id FROM ox_event GROUP BY coalesce(original_message_id, CAST(event_id AS VARCHAR)), event_type, recipient")
def rpy14(t):
    return R.distinct_events(events(t)).select("event_id")


@query("rpy15_dispatch_state", "SELECT d.dispatch_id, coalesce(s.st, 'UNKNOWN') AS delivery_state FROM fx_dispatches d LEFT JOIN (SELECT dispatch_id, arg_max(event_type, (received_at, event_id)) AS st FROM ox_matched WHERE dispatch_id IS NOT NULL GROUP BY ALL) s ON s.dispatch_id = d.dispatch_id")
def rpy15(t):
    d = t.view("fx_dispatches")
    return R.dispatch_state(d, R.match_dispatch(events(t), d.drop("email_id"))).select("dispatch_id", "delivery_state")


@query("rpy16_dispatch_history", "SELECT DISTINCT m.email_id, d.dispatch_id, d.delivery FROM fx_emails m JOIN fx_dispatches d ON d.email_id = m.email_id OR d.stage_id = 'STG-' || m.email_id OR d.stage_id = m.email_id")
def rpy16(t):
    return R.dispatch_history(t.mails, t.view("fx_dispatches")).select("email_id", "dispatch_id", "delivery")


@query("rpy17_clarification", """SELECT v.email_id, CASE WHEN missing_documents = '' AND status = 'OK' THEN 'VERIFIED' ELSE 'REJECTED' END AS decision, 'Re: ' || coalesce(nullif(trim(m.subject), ''), 'your transmission') || ' - ' ||
  CASE WHEN missing_documents <> '' THEN replace(missing_documents, ', ', ' and the ') || ' still required' WHEN status = 'MISMATCH' THEN 'Verification mismatch' WHEN status = 'OK' THEN 'Verification complete' ELSE 'More detail required' END AS reply_subject
  FROM ox_verdict v JOIN fx_all_mails m ON m.email_id = v.email_id""")
def rpy17(t):
    v = verdicts(t).select("email_id", "status", "defect_fields", "missing_documents", "review_reason").join(all_mails(t).select("email_id", "subject"), "email_id")
    return R.clarification(v).select("email_id", "decision", "reply_subject")


@query("rpy18_addressing", f"""SELECT email_id, n AS notice_to, CASE WHEN lower(sender) <> lower(n) THEN sender END AS cc FROM (SELECT *, coalesce(CASE WHEN contains(email_id, '7') THEN 'desk@x.org' END, nullif(regexp_extract(body, {D.q(rules.ORIGINAL_SENDER)}, 1), ''), sender) AS n FROM fx_all_mails) x""")
def rpy18(t):
    m = all_mails(t).withColumn("recipient", F.when(F.contains("email_id", F.lit("7")), "desk@x.org"))
    return R.addressing(m).select("email_id", "notice_to", "cc")
