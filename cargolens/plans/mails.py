"""Classification, document typing, pairing and the verdict per mail."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..operators import classify as C, compare as K, doctype as DT, extract as X, shipments as S
from . import duck as D
from .registry import query, step


def all_mails(t):
    att = F.filter(F.split("attachments_csv", r"\|"), lambda a: a != "")
    return t.view("fx_all_mails").withColumn("attachments", att).drop("attachments_csv")


# ------------------------------------------------------------- classification
step("ox_flags", f"""
SELECT m.email_id, sender, subject, body, attachments_csv,
  coalesce(list_bool_or(list_transform(att, lambda a: {D.any_of('a', ['_si.', '_si_', 'si.frombody'])} OR coalesce(({D.si_bl('a')}) = 'SI', false))), false) AS has_si,
  coalesce(list_bool_or(list_transform(att, lambda a: {D.any_of('a', ['_bl.', '_bl_', 'bl.frombody'])} OR coalesce(({D.si_bl('a')}) = 'BL', false))), false) AS has_bl,
  {D.has('s', rules.SUBJECT_IS_SI)} AS subject_si, {D.has('s', rules.SUBJECT_IS_BL)} AS subject_bl, {D.has('s', rules.SPAM_SUBJECT_WORD)} AS spam_word,
  {D.any_of('dom', rules.SPAM_DOMAIN_HINTS)} OR {D.has('dom', chr(92) + 'bspam' + chr(92) + 'b')} AS spam_domain,
  CAST({D.any_of('s', rules.SPAM_SUBJECT_HINTS)} AS INT) * 2 + CAST({D.any_of('b', rules.SPAM_BODY_HINTS)} AS INT) AS spam_score,
  {D.any_of('s', rules.SYSTEM_SUBJECTS)} OR contains(lower(sender), '{rules.SYSTEM_SENDER}') AS system_mail,
  {D.any_of('s', rules.INTERNAL_MARKERS)} OR {D.any_of('b', rules.INTERNAL_MARKERS)} AS internal_mail,
  {D.hits('s', 'b', rules.BL_REQUEST_HINTS)} AS bl_hits, {D.hits('s', 'b', rules.SI_REQUEST_HINTS)} AS si_hits, {D.hits('s', 'b', rules.INVOICE_HINTS)} AS inv_hits
FROM (SELECT *, lower(subject) AS s, lower(body) AS b, {D.atts('lower(attachments_csv)')} AS att,
        CASE WHEN contains(sender, '@') THEN regexp_replace(lower(regexp_extract(sender, '@([^@]*)$', 1)), '>+$', '') ELSE '' END AS dom FROM fx_all_mails) m
""")
step("ox_class", """
SELECT email_id, CASE
  WHEN has_si AND has_bl THEN CASE WHEN subject_si AND NOT subject_bl THEN 'SI_REQUEST' ELSE 'BL_COMPARISON' END
  WHEN spam_word OR spam_domain OR spam_score >= 3 THEN 'SPAM' WHEN system_mail THEN 'GENERAL'
  WHEN (has_si OR has_bl) AND bl_hits >= 1 THEN 'BL_COMPARISON' WHEN internal_mail THEN 'GENERAL'
  WHEN greatest(si_hits, inv_hits, bl_hits) = 0 THEN 'GENERAL' WHEN si_hits >= inv_hits AND si_hits >= bl_hits THEN 'SI_REQUEST'
  WHEN inv_hits >= bl_hits THEN 'INVOICE_QUERY' ELSE 'BL_COMPARISON' END AS category,
  CASE WHEN has_si AND has_bl THEN 0.95 WHEN spam_word THEN 0.99 WHEN spam_domain THEN 0.95 WHEN spam_score >= 3 THEN 0.9 WHEN system_mail THEN 0.95
  WHEN (has_si OR has_bl) AND bl_hits >= 1 THEN 0.7 WHEN internal_mail THEN 0.7 WHEN greatest(si_hits, inv_hits, bl_hits) = 0 THEN 0.6
  ELSE least(0.5::DOUBLE + 0.15::DOUBLE * greatest(si_hits, inv_hits, bl_hits), 0.9::DOUBLE) END::DOUBLE AS confidence FROM ox_flags
""")
for name, cols in {
    "cls1_paired_documents": ["has_si", "has_bl", "subject_si", "subject_bl"], "cls2_spam_word": ["spam_word"],
    "cls3_sender_domain": ["spam_domain"], "cls4_spam_score": ["spam_score"], "cls5_system_mail": ["system_mail"],
    "cls6_hint_counts": ["bl_hits", "si_hits", "inv_hits"], "cls8_internal_markers": ["internal_mail"],
}.items():
    query(name, f"SELECT email_id, {', '.join(cols)} FROM ox_flags")(
        lambda t, cols=cols: C.with_flags(all_mails(t)).select("email_id", *cols))


@query("cls7_one_document_wording", "SELECT email_id, (has_si OR has_bl) AND NOT (has_si AND has_bl) AND bl_hits >= 1 AS one_document FROM ox_flags")
def cls7(t):
    one = (F.col("has_si") | F.col("has_bl")) & ~(F.col("has_si") & F.col("has_bl")) & (F.col("bl_hits") >= 1)
    return C.with_flags(all_mails(t)).select("email_id", one.alias("one_document"))


@query("cls9_category", "SELECT email_id, category, round(confidence, 4) AS confidence FROM ox_class")
def cls9(t):
    return C.classify(all_mails(t)).select("email_id", "category", F.round("confidence", 4).alias("confidence"))


@query("cls10_provider_backfill", "SELECT email_id, coalesce(classify_source, 'rule-classifier') AS classify_source FROM fx_reports")
def cls10(t):
    return C.with_source(t.view("fx_reports")).select("email_id", "classify_source")


@query("flt10_document_request", f"""SELECT email_id, {D.has('body', rules.DOCUMENT_REQUEST)} AND NOT {D.has('body', rules.DECLARED_MISSING)}
  AND NOT {D.has('body', rules.ASKED_TO_COMPARE)} AS is_request FROM fx_all_mails""")
def flt10(t):
    return all_mails(t).select("email_id", C.is_document_request(F.col("body")).alias("is_request"))


# -------------------------------------------------------------- document typing
@query("doc1_si_bl_by_name", f"SELECT id, {D.si_bl('name')} AS kind FROM fx_files")
def doc1(t):
    return t.view("fx_files").select("id", DT.si_bl_of(F.col("name")).alias("kind"))


@query("doc2_kind_by_name", f"SELECT id, coalesce({D.si_bl('name')}, CASE WHEN {D.has('name', rules.INVOICE_NAME)} THEN 'INVOICE' END) AS kind FROM fx_files")
def doc2(t):
    return t.view("fx_files").select("id", DT.kind_of(F.col("name")).alias("kind"))


@query("doc3_synthetic", "SELECT id, contains(lower(name), '.frombody') AS synthetic FROM fx_files")
def doc3(t):
    return t.view("fx_files").select("id", DT.is_synthetic(F.col("name")).alias("synthetic"))


step("ox_att", f"""
SELECT m.email_id, u.a AS path, u.i AS pos, CAST(contains(lower(u.a), '.frombody') AS INT) AS syn,
  upper(regexp_extract(u.a, '(?i)_(SI|BL)[.][a-z]+$', 1)) AS tier1, {D.si_bl('u.a')} AS tier2
FROM (SELECT email_id, {D.atts()} AS l FROM fx_all_mails) m, LATERAL (SELECT unnest(m.l) AS a, generate_subscripts(m.l, 1) AS i) u
""")
step("ox_tier1", "SELECT email_id, tier1 AS kind, arg_min(path, syn * 1000 + pos) AS path FROM ox_att WHERE tier1 <> '' GROUP BY ALL")
step("ox_pairing", """
SELECT m.email_id, max(coalesce(t.path, x.path)) FILTER (WHERE k.kind = 'SI') AS si_path, max(coalesce(t.path, x.path)) FILTER (WHERE k.kind = 'BL') AS bl_path
FROM fx_all_mails m CROSS JOIN (VALUES ('SI'), ('BL')) k(kind) LEFT JOIN ox_tier1 t ON t.email_id = m.email_id AND t.kind = k.kind
LEFT JOIN (SELECT a.email_id, a.tier2 AS kind, arg_min(a.path, a.syn * 1000 + a.pos) AS path FROM ox_att a
   WHERE a.tier2 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ox_tier1 c WHERE c.email_id = a.email_id AND c.path = a.path) GROUP BY ALL) x
  ON x.email_id = m.email_id AND x.kind = k.kind GROUP BY m.email_id
""")


@query("doc4_attachment_pair", "SELECT email_id, si_path, bl_path FROM ox_pairing")
def doc4(t):
    return DT.with_pair(all_mails(t)).select("email_id", "si_path", "bl_path")


_title = "CASE " + " ".join(f"WHEN {D.has('l', '(?i)' + p)} THEN {i}" for i, (p, _) in enumerate(rules.DOC_TITLES)) + " END"
_kind = "CASE p " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(rules.DOC_TITLES)) + " END"
step("ox_declared", f"""
SELECT d.path, d.email_id, d.doc_type, h.declared FROM fx_docs d LEFT JOIN (
  SELECT path, arg_min({_kind}, ln) AS declared FROM (SELECT path, ln, {_title} AS p FROM (
    SELECT path, ln, {D.strip('line')} AS l FROM ox_line WHERE NOT {D.has(D.squeeze('line'), X.ANY_LABEL)}) a) b
  WHERE p IS NOT NULL GROUP BY path) h ON h.path = d.path
""")


@query("doc5_declared_type", "SELECT path, declared FROM ox_declared")
def doc5(t):
    return t.docs.select("path", DT.declared_type(F.col("text")).alias("declared"))


@query("doc6_wrong_document", "SELECT path, declared IS NOT NULL AND declared <> doc_type AS wrong FROM ox_declared")
def doc6(t):
    d = t.docs.withColumn("declared", DT.declared_type(F.col("text")))
    return d.select("path", F.coalesce(F.col("declared") != F.col("doc_type"), F.lit(False)).alias("wrong"))


_loose = """CASE WHEN contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 'shippinginstruction') OR regexp_matches(lower(name), '(^|[^a-z])si([^a-z]|$)') THEN 'SI'
  WHEN regexp_matches(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 'billoflading|draftbl') OR regexp_matches(lower(name), '(^|[^a-z])bl([^a-z]|$)') THEN 'BL'
  WHEN regexp_matches(lower(name), 'invoice|_inv|^inv') THEN 'INVOICE' END"""


@query("doc7_loose_kind", f"SELECT id, {_loose} AS kind FROM fx_files")
def doc7(t):
    return t.view("fx_files").select("id", DT.loose_kind(F.col("name")).alias("kind"))


@query("doc8_document_summary", f"""
SELECT email_id, coalesce({_loose}, 'UNKNOWN') AS type, name AS filename, CASE WHEN {_loose} IS NULL THEN 'received' ELSE 'detected' END AS status
FROM (SELECT email_id, unnest({D.atts()}) AS name FROM fx_all_mails) a
UNION ALL SELECT email_id, kind, NULL, 'missing' FROM (SELECT email_id, 'SI' AS kind FROM ox_pairing WHERE si_path IS NULL AND bl_path IS NOT NULL
  UNION ALL SELECT email_id, 'BL' FROM ox_pairing WHERE bl_path IS NULL AND si_path IS NOT NULL) b""")
def doc8(t):
    m = DT.with_pair(all_mails(t))
    kind = DT.loose_kind(F.col("filename"))
    have = m.select("email_id", F.explode("attachments").alias("filename")).select(
        "email_id", F.coalesce(kind, F.lit("UNKNOWN")).alias("type"), "filename", F.when(kind.isNull(), "received").otherwise("detected").alias("status"))
    si, bl = F.col("si_path").isNull(), F.col("bl_path").isNull()
    gone = F.array_compact(F.array(F.when(si & ~bl, F.lit("SI")), F.when(bl & ~si, F.lit("BL"))))
    absent = m.select("email_id", F.explode(gone).alias("type")).select(
        "email_id", "type", F.lit(None).cast("string").alias("filename"), F.lit("missing").alias("status"))
    return have.unionByName(absent)


step("ox_kinds", f"SELECT m.email_id, list_sort(list_distinct(list(a.tier2) FILTER (WHERE a.tier2 IS NOT NULL AND a.syn = 0))) AS kinds FROM fx_all_mails m LEFT JOIN ox_att a ON a.email_id = m.email_id GROUP BY ALL")
step("ox_inline", r"""
SELECT email_id, subject, body, CASE WHEN (si AND NOT bl) THEN 'SI' WHEN (bl AND NOT si) THEN 'BL' END AS kind FROM (
  SELECT m.email_id, subject, body, regexp_matches(subject || chr(10) || body, '(?i)\bshipping\s+instruction\b') AND NOT coalesce(list_contains(k.kinds, 'SI'), false) AS si,
    regexp_matches(subject || chr(10) || body, '(?i)\bbill\s+of\s+lading\b') AND NOT coalesce(list_contains(k.kinds, 'BL'), false) AS bl
  FROM fx_all_mails m JOIN ox_kinds k ON k.email_id = m.email_id) x
""")


@query("doc9_inline_documents", r"""
SELECT email_id, coalesce(nullif(regexp_extract(subject || chr(10) || body, '\b[A-Z]{2,6}-\d{2,6}\b'), ''), 'UNKNOWN') || '_' || kind || '.frombody.txt' AS path,
  CASE WHEN subject <> '' AND NOT contains(lower(body), lower(subject)) THEN subject || chr(10) || chr(10) || body ELSE body END AS text FROM ox_inline WHERE kind IS NOT NULL""")
def doc9(t):
    return DT.with_inline_document(all_mails(t)).filter("inline_kind IS NOT NULL").select(
        "email_id", F.col("inline_path").alias("path"), F.col("inline_text").alias("text"))


# Stored files of other mails, named by shipment reference; the draft some half-mails lack came with another mail.
STORED = """SELECT 'store/' || CAST(k % 3 AS STRING) || '/SHP-' || lpad(CAST(k AS STRING),6,'0') || '_' || doc_type || '_' || CAST(k % 2 AS STRING) || '.txt' AS path FROM fx_docs
UNION ALL SELECT 'store/9/SHP-' || lpad(CAST(k AS STRING),6,'0') || '_BL_0.txt' FROM fx_ship WHERE f = 10"""


step("ox_stored", STORED)
step("ox_ref", r"""
SELECT m.email_id, coalesce(nullif(regexp_extract(m.subject || chr(10) || m.body, '\b[A-Z]{2,6}-\d{2,6}\b'), ''),
  upper(nullif(regexp_extract(m.attachments_csv, '(?i)([A-Za-z0-9]+-[A-Za-z0-9]+)_(SI|BL)[._]', 1), ''))) AS ref,
  CASE WHEN len(k.kinds) = 1 THEN CASE k.kinds[1] WHEN 'SI' THEN 'BL' ELSE 'SI' END END AS other
FROM fx_all_mails m JOIN ox_kinds k ON k.email_id = m.email_id""")


@query("doc10_counterpart", """SELECT r.email_id, min(s.path) AS counterpart_path FROM ox_ref r LEFT JOIN ox_stored s
  ON upper(regexp_extract(s.path, '([^/]*)_(SI|BL)_', 1)) = r.ref AND regexp_extract(s.path, '_(SI|BL)_', 1) = r.other GROUP BY r.email_id""")
def doc10(t):
    return DT.with_counterpart(all_mails(t), t.sql(STORED)).select("email_id", "counterpart_path")


@query("doc11_mail_reference", r"""
SELECT email_id, upper(coalesce(nullif(regexp_extract(subject || chr(10) || body, '\b[A-Z]{2,6}-\d{2,6}\b'), ''),
  nullif(regexp_extract(attachments_csv, '(?i)([A-Za-z0-9]+-[A-Za-z0-9]+)_(SI|BL)[._]', 1), ''))) AS ref FROM fx_all_mails""")
def doc11(t):
    return all_mails(t).select("email_id", DT.mail_reference(F.col("subject"), F.col("body"), F.col("attachments")).alias("ref"))


# -------------------------------------------------------------------- verdicts
step("ox_verdict", f"""
SELECT c.email_id, c.category, CASE WHEN st IN ('wrong','unreadable','missing') THEN 'NEEDS_REVIEW' WHEN st = 'skip' THEN 'SKIPPED' WHEN st = 'request' THEN 'OK' ELSE r.status END AS status,
  CASE st WHEN 'wrong' THEN 'wrong_doc_type' WHEN 'unreadable' THEN 'unreadable' WHEN 'missing' THEN 'missing_attachment' WHEN 'compare' THEN r.review_reason END AS review_reason,
  CASE WHEN st = 'compare' THEN r.has_defect ELSE false END AS has_defect, CASE WHEN st = 'compare' THEN r.defect_fields ELSE '' END AS defect_fields,
  CASE WHEN st = 'missing' THEN concat_ws(', ', CASE WHEN c.si_path IS NULL THEN 'SI' END, CASE WHEN c.bl_path IS NULL THEN 'BL' END) ELSE '' END AS missing_documents,
  CASE WHEN st = 'missing' THEN concat_ws(', ', CASE WHEN c.si_path IS NOT NULL THEN 'SI' END, CASE WHEN c.bl_path IS NOT NULL THEN 'BL' END) ELSE '' END AS present_documents,
  CASE WHEN st = 'unreadable' THEN concat_ws(', ', CASE WHEN si_empty THEN 'SI' END, CASE WHEN bl_empty THEN 'BL' END) ELSE '' END AS unreadable_documents
FROM (SELECT *, CASE WHEN category <> 'BL_COMPARISON' THEN 'skip' WHEN (si_path IS NULL OR bl_path IS NULL) THEN CASE WHEN is_request THEN 'request' ELSE 'missing' END
    WHEN si_wrong OR bl_wrong THEN 'wrong' WHEN si_empty OR bl_empty THEN 'unreadable' ELSE 'compare' END AS st FROM (
  SELECT k.email_id, k.category, p.si_path, p.bl_path,
    {D.has('m.body', rules.DOCUMENT_REQUEST)} AND NOT {D.has('m.body', rules.DECLARED_MISSING)} AND NOT {D.has('m.body', rules.ASKED_TO_COMPARE)} AS is_request,
    coalesce(s.declared <> 'SI', false) AS si_wrong, coalesce(b.declared <> 'BL', false) AS bl_wrong,
    coalesce(sd.text, '') = '' AS si_empty, coalesce(bd.text, '') = '' AS bl_empty
  FROM ox_class k JOIN fx_all_mails m ON m.email_id = k.email_id JOIN ox_pairing p ON p.email_id = k.email_id
  LEFT JOIN ox_declared s ON s.path = p.si_path LEFT JOIN ox_declared b ON b.path = p.bl_path
  LEFT JOIN fx_docs sd ON sd.path = p.si_path LEFT JOIN fx_docs bd ON bd.path = p.bl_path) x) c
LEFT JOIN ox_roll r ON r.email_id = c.email_id
""")


def verdicts(t):
    return K.verdicts(all_mails(t), t.docs.select("path", "text"))


@query("cmp12_mail_verdicts", "SELECT email_id, category, status, review_reason, has_defect, defect_fields FROM ox_verdict")
def cmp12(t):
    return verdicts(t).select("email_id", "category", "status", "review_reason", "has_defect", F.array_join("defect_fields", ",").alias("defect_fields"))


@query("cmp13_document_evidence", "SELECT email_id, missing_documents, present_documents, unreadable_documents FROM ox_verdict")
def cmp13(t):
    return verdicts(t).select("email_id", *[F.array_join(c, ", ").alias(c) for c in ("missing_documents", "present_documents", "unreadable_documents")])


@query("cmp14_suggested_action", """
SELECT email_id, CASE WHEN status = 'SKIPPED' THEN 'ROUTE_TO_' || category WHEN status = 'MISMATCH' THEN 'NOTIFY_FORWARDER_AMENDMENT: ' || replace(defect_fields, ',', ', ')
  WHEN status = 'NEEDS_REVIEW' AND review_reason = 'missing_attachment' THEN 'REQUEST_MISSING_DOCUMENTS: ' || missing_documents
  WHEN status = 'NEEDS_REVIEW' AND review_reason = 'unreadable' THEN 'MANUAL_REVIEW_UNREADABLE: ' || unreadable_documents
  WHEN status = 'NEEDS_REVIEW' THEN 'ESCALATE_TO_REVIEW_DESK: ' || coalesce(review_reason, 'undecidable') ELSE 'AUTO_APPROVE' END AS suggested_action,
  CASE WHEN review_reason = 'missing_attachment' AND missing_documents <> '' THEN 'request_document' WHEN status = 'MISMATCH' THEN 'review_mismatch' WHEN status = 'NEEDS_REVIEW' THEN 'manual_review' END AS action_type
FROM ox_verdict""")
def cmp14(t):
    return K.suggested_action(verdicts(t)).select("email_id", "suggested_action", "action_type")


step("ox_alert", "SELECT id, k, email_id, security_status = 'BLOCKED' AS security_alert, category, CASE WHEN category = 'BL_COMPARISON' THEN 'OK' ELSE 'SKIPPED' END AS status FROM (SELECT *, id AS k FROM fx_staged) x")


@query("cmp15_security_first", """SELECT email_id, CASE WHEN security_alert THEN 'SPAM' ELSE category END AS category, CASE WHEN security_alert THEN 'ERROR' ELSE status END AS status,
  CASE WHEN security_alert THEN 'security_quarantine' END AS review_reason,
  CASE WHEN security_alert THEN 'QUARANTINE_AND_ALERT_SECURITY' WHEN status = 'SKIPPED' THEN 'ROUTE_TO_' || category ELSE 'AUTO_APPROVE' END AS suggested_action FROM ox_alert""")
def cmp15(t):
    none = F.array().cast("array<string>")
    df = t.view("fx_staged").select("email_id", "category", (F.col("security_status") == "BLOCKED").alias("security_alert"))
    df = df.withColumn("status", F.when(F.col("category") == "BL_COMPARISON", "OK").otherwise("SKIPPED")).withColumn("review_reason", F.lit(None).cast("string"))
    for c in ("defect_fields", "missing_documents", "unreadable_documents"):
        df = df.withColumn(c, none)
    return K.suggested_action(df).select("email_id", "category", "status", "review_reason", "suggested_action")


@query("cmp18_release_action", """SELECT email_id, CASE status WHEN 'OK' THEN 'RELEASE_BL' WHEN 'MISMATCH' THEN 'HOLD_BL_RELEASE' WHEN 'NEEDS_REVIEW' THEN 'HUMAN_REVIEW'
  ELSE CASE WHEN category = 'SI_REQUEST' THEN 'ROUTE_TO_SI_REQUEST' ELSE 'NO_ACTION' END END AS action FROM fx_reports""")
def cmp18(t):
    return t.view("fx_reports").select("email_id", K.release_action(F.col("category"), F.col("status")).alias("action"))
