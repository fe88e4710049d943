"""Shipments, versions, issues and overview."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..operators import compare as K, extract as X, issues as I, overview as O, shipments as S, versions as V
from ..operators.ranking import latest
from ..streaming import jobs as J, overview as MO
from . import duck as D
from .mails import all_mails
from .registry import query, step

# ------------------------------------------------------------------ identifiers
step("ox_text", "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT path, text || chr(10) || 'Vessel: EVER GLORY V.' || CAST(k AS VARCHAR) || 'E' || chr(10) || 'Voy. No: ' || CAST(k AS VARCHAR) || 'E MSKU' || lpad(CAST(k AS VARCHAR),7,'0') || ' TGHU' || lpad(CAST(k % 9 AS VARCHAR),7,'0') FROM fx_docs")


def texts(t):
    prose = t("documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    k = F.col("k").cast("string")
    tail = F.concat(F.lit("\nVessel: EVER GLORY V."), k, F.lit("E\nVoy. No: "), k, F.lit("E MSKU"), F.lpad(k, 7, "0"), F.lit(" TGHU"), F.lpad((F.col("k") % 9).cast("string"), 7, "0"))
    return prose.unionByName(t.docs.select(F.col("path").alias("id"), F.concat("text", tail).alias("text")))


step("ox_refs", f"""SELECT id, arg_min(r, i) AS reference FROM (SELECT id, upper({D.sub('r', '^[.,;:]+|[.,;:]+$')}) AS r, i FROM (
  SELECT id, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM (SELECT id, regexp_extract_all(text, {D.q(rules.REFERENCE_LABEL)}, 1) AS l FROM ox_text) a) b) c
  WHERE regexp_matches(r, '[0-9]') AND length(r) >= 4 AND NOT {D.in_list('r', rules.NOT_A_REFERENCE)} GROUP BY id""")


@query("ext15_document_reference", "SELECT x.id, r.reference FROM ox_text x LEFT JOIN ox_refs r ON r.id = x.id")
def ext15(t):
    return texts(t).select("id", T.document_reference(F.col("text")).alias("reference"))


@query("ext16_container_numbers", f"""SELECT id, list_aggregate(list_filter(l, lambda x, i: list_position(l, x) = i), 'string_agg', ',') AS containers
  FROM (SELECT id, regexp_extract_all(upper(text), {D.q(rules.CONTAINER_NUMBER)}, 1) AS l FROM ox_text) a WHERE len(l) > 0""")
def ext16(t):
    return texts(t).select("id", F.array_join(T.container_numbers(F.col("text")), ",").alias("containers")).filter("containers <> ''")


_ves = D.sub(D.sub(D.ext("text", rules.VESSEL), rules.VESSEL_TAIL), "^[ .,;]+|[ .,;]+$")
_voy = D.sub(D.ext("text", rules.VOYAGE), "^[ .,;]+|[ .,;]+$")


@query("ext17_vessel_voyage", f"""SELECT id, CASE WHEN length(v) >= 3 AND NOT regexp_matches(v, '^[0-9]+$') THEN v END AS vessel, CASE WHEN regexp_matches(y, '[0-9]') THEN y END AS voyage
  FROM (SELECT id, {_ves} AS v, {_voy} AS y FROM ox_text) x""")
def ext17(t):
    return texts(t).select("id", T.vessel(F.col("text")).alias("vessel"), T.voyage(F.col("text")).alias("voyage"))


step("ox_ident", f"""SELECT d.k, d.path, d.email_id, d.doc_type, r.reference FROM fx_docs d LEFT JOIN ox_refs r ON r.id = d.path""")


@query("ext18_merged_identifiers", "SELECT k, arg_min(reference, path) FILTER (WHERE reference IS NOT NULL) AS reference FROM (SELECT CAST(floor(k / 10) AS BIGINT) AS k, path, reference FROM ox_ident) x GROUP BY k")
def ext18(t):
    d = t.docs.select(F.floor(F.col("k") / 10).cast("bigint").alias("k"), "path", S.identifiers(F.concat("text", F.lit("\nVoy. No: 1E"))).alias("ids"))
    return S.merge_identifiers(d, ["k"], "path").select("k", "reference")


@query("ext18b_merged_containers", """SELECT g, container, min(id) AS first_doc FROM (SELECT CAST(length(id) AS INT) AS g, id, unnest(regexp_extract_all(upper(text), '\\b([A-Z]{3}[UJZ]\\d{7})\\b', 1)) AS container FROM ox_text) x GROUP BY ALL""")
def ext18b(t):
    d = texts(t).select("id", F.length("id").alias("g"), S.identifiers(F.col("text")).alias("ids"))
    return S.merged_containers(d, ["g"], "id").select("g", "container", F.col("first.id").alias("first_doc"))


# ------------------------------------------------------------------- shipments
_mailref = f"upper(replace(nullif(regexp_extract(subject || ' ' || body || ' ' || replace(attachments_csv, '|', ' '), {D.q(rules.MAIL_REFERENCE)}), ''), ' ', '-'))"


@query("shp1_mail_reference", f"SELECT email_id, {_mailref} AS reference FROM fx_all_mails")
def shp1(t):
    return all_mails(t).select("email_id", S.mail_code(F.col("subject"), F.col("body"), F.col("attachments")).alias("reference"))


# Every seventh mail states a reference, every third document none, every fifth shipment has marks.
step("ox_sig", """SELECT p.k, p.email_id, p.doc_type, p.reference, n.shipper, n.port_of_loading, n.port_of_discharge
FROM ox_ident p JOIN ox_norm n ON n.email_id = p.email_id AND n.doc_type = p.doc_type""")


@query("shp2_shipment_key", """SELECT email_id, doc_type, coalesce('REF:MR' || CASE WHEN k % 7 = 0 THEN k END, 'REF:' || upper(CASE WHEN k % 3 <> 0 THEN reference END), CASE WHEN shipper <> '' AND port_of_loading <> '' AND port_of_discharge <> ''
    THEN 'SIG:' || sha256(concat_ws('|', shipper, port_of_loading, port_of_discharge, CASE WHEN k % 5 = 0 THEN 'CTR:ABCU' || k END)) END, 'EMAIL:' || email_id) AS shipment_key FROM ox_sig""")
def shp2(t):
    d = K.read_documents(t.docs)
    n = F.col("norm")
    k = F.col("k").cast("string")
    marks = F.when(F.col("k") % 5 == 0, F.array(F.concat(F.lit("CTR:ABCU"), k))).otherwise(F.array().cast("array<string>"))
    key = S.shipment_key(F.when(F.col("k") % 7 == 0, F.concat(F.lit("mr"), k)), F.when(F.col("k") % 3 != 0, T.document_reference(F.col("text"))), n["shipper"],
                         n["port_of_loading"]["value"], n["port_of_discharge"]["value"], marks, F.col("email_id"))
    return d.select("email_id", "doc_type", key.alias("shipment_key"))


@query("shp3_discriminators", r"""SELECT id, concat_ws('|', CASE WHEN len(l) > 0 THEN 'CTR:' || list_aggregate(list_sort(list_distinct(l)), 'string_agg', ',') END,
  CASE WHEN v IS NOT NULL OR y IS NOT NULL THEN 'VES:' || upper(coalesce(v, '')) || ':' || upper(coalesce(y, '')) END) AS marks FROM (
  SELECT id, regexp_extract_all(upper(text), '\b([A-Z]{3}[UJZ]\d{7})\b', 1) AS l, CASE WHEN length(v0) >= 3 AND NOT regexp_matches(v0, '^[0-9]+$') THEN v0 END AS v, CASE WHEN regexp_matches(y0, '[0-9]') THEN y0 END AS y
  FROM (SELECT id, text, """ + _ves + " AS v0, " + _voy + " AS y0 FROM ox_text) a) b")
def shp3(t):
    d = texts(t).withColumn("i", S.identifiers(F.col("text")))
    return d.select("id", F.array_join(S.discriminators(F.col("i.containers"), F.col("i.vessel"), F.col("i.voyage")), "|").alias("marks"))


@query("shp4_signing_fields", """SELECT coalesce(s.email_id, b.email_id) AS email_id, coalesce(s.shipper, b.shipper) AS shipper, coalesce(s.port_of_loading, b.port_of_loading) AS port_of_loading,
  coalesce(s.port_of_discharge, b.port_of_discharge) AS port_of_discharge FROM (SELECT * FROM ox_fields WHERE doc_type = 'SI') s FULL JOIN (SELECT * FROM ox_fields WHERE doc_type = 'BL') b ON b.email_id = s.email_id""")
def shp4(t):
    f = X.with_fields(t.docs).select("email_id", "doc_type", "fields")
    half = lambda d: f.filter(F.col("doc_type") == d).select("email_id", F.col("fields").alias(d.lower()))
    j = half("SI").join(half("BL"), "email_id", "full")
    return j.select("email_id", S.signing_fields(F.col("si"), F.col("bl")).alias("s")).select("email_id", "s.*")


step("ox_newreg", "SELECT reg_id, shipment_key, CASE WHEN reg_id % 3 = 0 THEN NULL ELSE doc_type || CAST(reg_id AS VARCHAR) END AS reference FROM fx_regs")


@query("shp5_shipments", "SELECT shipment_key, arg_min(reference, reg_id) FILTER (WHERE reference IS NOT NULL) AS reference_number, min(reg_id) AS first_reg FROM ox_newreg GROUP BY shipment_key")
def shp5(t):
    ref = F.when(F.col("reg_id") % 3 != 0, F.concat("doc_type", F.col("reg_id").cast("string")))
    return S.shipments(t.view("fx_regs").select("reg_id", "shipment_key", ref.alias("reference")))


@query("shp6_filed_documents", """SELECT p.email_id, k.kind AS doc_type, CASE k.kind WHEN 'SI' THEN si_path ELSE bl_path END AS path,
  NOT (c.category = 'BL_COMPARISON' AND si_path IS NOT NULL AND bl_path IS NOT NULL) AS lone
  FROM ox_pairing p JOIN ox_class c ON c.email_id = p.email_id CROSS JOIN (VALUES ('SI'), ('BL')) k(kind)
  WHERE c.category IN ('BL_COMPARISON', 'SI_REQUEST') AND CASE k.kind WHEN 'SI' THEN si_path ELSE bl_path END IS NOT NULL""")
def shp6(t):
    from ..operators import classify as C, doctype as DT
    return S.filed_documents(DT.with_pair(C.classify(all_mails(t)))).select("email_id", "doc_type", "path", "lone")


@query("shp7_invoice_attachment", """SELECT e.event_id, coalesce(CASE WHEN e.event_id % 2 = 0 THEN 'REF:SHP-' || lpad(CAST(e.user_id AS VARCHAR),4,'0') END, 'REF:SHP-' || lpad(CAST(e.event_id AS VARCHAR),4,'0')) AS shipment_key
  FROM events e WHERE e.event_type = 'purchase' AND coalesce(CASE WHEN e.event_id % 2 = 0 THEN 'REF:SHP-' || lpad(CAST(e.user_id AS VARCHAR),4,'0') END, 'REF:SHP-' || lpad(CAST(e.event_id AS VARCHAR),4,'0'))
    IN (SELECT shipment_key FROM fx_regs WHERE doc_type <> 'INVOICE')""")
def shp7(t):
    code = lambda c: F.concat(F.lit("REF:SHP-"), F.lpad(F.col(c).cast("string"), 4, "0"))
    inv = t("events").filter("event_type = 'purchase'").select(
        "event_id", F.when(F.col("event_id") % 2 == 0, code("user_id")).alias("pair_key"), code("event_id").alias("mail_key"))
    return S.attach_invoices(inv, t.view("fx_regs").filter("doc_type <> 'INVOICE'")).select("event_id", "shipment_key")


# -------------------------------------------------------------------- versions
step("ox_hash", """SELECT *, sha256(content) AS content_hash, CASE WHEN boxes IS NOT NULL THEN sha256('container_count=' || boxes) ELSE 'nosig:' || sha256(content) END AS normalized_hash FROM fx_regs""")
step("ox_dup", """SELECT *, CASE WHEN f < reg_id THEN f END AS duplicate_of FROM (
  SELECT *, least(min(reg_id) OVER (PARTITION BY shipment_key, doc_type, content_hash), min(reg_id) OVER (PARTITION BY shipment_key, doc_type, normalized_hash)) AS f FROM ox_hash) x""")
step("ox_chain", """SELECT *, row_number() OVER w AS version_number, lag(reg_id) OVER w AS previous_version_id, row_number() OVER (PARTITION BY shipment_key, doc_type ORDER BY coalesce(received_at, created_at) DESC, reg_id DESC) = 1 AS is_latest
  FROM ox_dup WHERE duplicate_of IS NULL WINDOW w AS (PARTITION BY shipment_key, doc_type ORDER BY coalesce(received_at, created_at), reg_id)""")


def regs(t):
    fields = F.create_map(F.lit("container_count"), F.col("boxes"))
    return (t.view("fx_regs").withColumn("content_hash", V.content_hash(F.col("content")))
            .withColumn("normalized_hash", V.normalised_hash(fields, F.col("content"))))


@query("ver1_content_hash", "SELECT reg_id, content_hash FROM ox_hash")
def ver1(t):
    return regs(t).select("reg_id", "content_hash")


@query("ver2_normalised_hash", "SELECT reg_id, normalized_hash FROM ox_hash")
def ver2(t):
    return regs(t).select("reg_id", "normalized_hash")


@query("ver3_duplicates", "SELECT reg_id, duplicate_of, CASE WHEN duplicate_of IS NULL THEN 'ACTIVE' ELSE 'DUPLICATE' END AS document_status FROM ox_dup")
def ver3(t):
    return V.with_duplicates(regs(t)).select("reg_id", "duplicate_of", "document_status")


def register(t):
    return V.document_versions(regs(t))


def chain(t):
    return V.version_chain(V.with_duplicates(regs(t)).filter("document_status = 'ACTIVE'"))


@query("ver4_version_chain", "SELECT reg_id, version_number FROM ox_chain UNION ALL SELECT d.reg_id, c.version_number FROM ox_dup d LEFT JOIN ox_chain c ON c.reg_id = d.duplicate_of WHERE d.duplicate_of IS NOT NULL")
def ver4(t):
    return register(t).select("reg_id", "version_number")


@query("ver5_previous_version", "SELECT reg_id, previous_version_id FROM ox_chain")
def ver5(t):
    return chain(t).select("reg_id", "previous_version_id")


@query("ver6_current_version", "SELECT shipment_key, doc_type, reg_id FROM ox_chain WHERE is_latest")
def ver6(t):
    return V.latest_versions(V.with_duplicates(regs(t)).filter("document_status = 'ACTIVE'")).select("shipment_key", "doc_type", "reg_id")


@query("ver7_latest_pairs", """SELECT shipment_key, max(content) FILTER (WHERE doc_type = 'SI') AS si_content, max(content) FILTER (WHERE doc_type = 'BL') AS bl_content
  FROM ox_chain WHERE is_latest AND doc_type IN ('SI', 'BL') GROUP BY shipment_key""")
def ver7(t):
    return V.latest_pairs(V.with_duplicates(regs(t)).filter("document_status = 'ACTIVE'"), "content")


@query("ver8_version_diff", """SELECT a.shipment_key, a.doc_type, a.version_number, f.field, CASE f.field WHEN 'content' THEN b.content ELSE b.boxes END AS from_value,
  CASE f.field WHEN 'content' THEN a.content ELSE a.boxes END AS to_value,
  CASE f.field WHEN 'content' THEN a.content IS DISTINCT FROM b.content ELSE a.boxes IS DISTINCT FROM b.boxes END AS changed
  FROM ox_chain a JOIN ox_chain b ON b.reg_id = a.previous_version_id CROSS JOIN (VALUES ('content'), ('boxes')) f(field)""")
def ver8(t):
    return V.version_diff(chain(t), ["content", "boxes"])


@query("ver9_fingerprint_versions", """SELECT i.reg_id, coalesce(c.n, 0) + CASE WHEN k.content IS NULL THEN 1 ELSE 0 END AS version FROM (SELECT * FROM fx_regs WHERE created_at >= TIMESTAMP '2024-01-20') i
  LEFT JOIN (SELECT shipment_key, doc_type, count(DISTINCT content) AS n FROM fx_regs WHERE created_at < TIMESTAMP '2024-01-20' GROUP BY ALL) c ON c.shipment_key = i.shipment_key AND c.doc_type = i.doc_type
  LEFT JOIN (SELECT DISTINCT shipment_key, doc_type, content FROM fx_regs WHERE created_at < TIMESTAMP '2024-01-20') k ON k.shipment_key = i.shipment_key AND k.doc_type = i.doc_type AND k.content = i.content""")
def ver9(t):
    r = t.view("fx_regs").withColumn("fingerprint", F.col("content"))
    old = "created_at < TIMESTAMP_NTZ '2024-01-20 00:00:00'"
    return V.fingerprint_versions(r.filter(f"NOT ({old})"), r.filter(old)).select("reg_id", "version")


@query("ver10_late_documents", """SELECT shipment_key, doc_type, reg_id, version_number FROM (SELECT *, max(reg_id) OVER (PARTITION BY shipment_key, doc_type) AS newest FROM ox_chain) x WHERE reg_id = newest AND NOT is_latest""")
def ver10(t):
    c = chain(t)
    newest = c.groupBy(*V.DOC).agg(F.max("reg_id").alias("reg_id"))
    return c.join(newest, [*V.DOC, "reg_id"]).filter("NOT is_latest").select(*V.DOC, "reg_id", "version_number")


# ---------------------------------------------------------------------- issues
_diff = """CASE field_name WHEN 'gross_weight_kg' THEN printf('%g', abs(CAST(bl_value AS DOUBLE) - CAST(si_value AS DOUBLE))) || ' kg'
  WHEN 'container_count' THEN CAST(abs(CAST(bl_value AS BIGINT) - CAST(si_value AS BIGINT)) AS VARCHAR) || ' container(s)' END"""
_diff = _diff.replace("CAST(bl_value AS", "TRY_CAST(bl_value AS").replace("CAST(si_value AS", "TRY_CAST(si_value AS").replace("TRY_TRY_", "TRY_")
step("ox_issue", f"SELECT *, {_diff} AS difference FROM fx_issues")


def reports_with_results(t, issues="fx_issues"):
    r = t.view(issues)
    res = F.array(F.struct(F.col("field_name").alias("field"), "si_value", "bl_value", F.lit("DIFF").alias("match")),
                  F.struct(F.lit("shipper").alias("field"), F.lit("A").alias("si_value"), F.lit("A").alias("bl_value"), F.lit("MATCH").alias("match")))
    return r.select("report_id", "email_id", "shipment_key", res.alias("field_results"))


@query("iss1_issues", "SELECT CAST(report_id AS VARCHAR) || ':' || field_name AS issue_key, shipment_key, email_id, field_name, si_value, bl_value FROM fx_issues")
def iss1(t):
    return I.issues_of(reports_with_results(t)).select("issue_key", "shipment_key", "email_id", "field_name", "si_value", "bl_value")


@query("iss3_suggested_resolutions", "SELECT CAST(report_id AS VARCHAR) || ':' || field_name AS issue_key, si_value AS suggested_value, 'UPDATE_BL_' || upper(field_name) AS suggested_action FROM fx_issues")
def iss3(t):
    return I.issues_of(reports_with_results(t)).select("issue_key", "suggested_value", "suggested_action")


@query("cmp8_difference", "SELECT report_id, difference FROM ox_issue")
def cmp8(t):
    return I.issues_of(reports_with_results(t)).select("report_id", "difference")


@query("cmp9_explanation", "SELECT report_id, 'BL ' || replace(field_name, '_', ' ') || coalesce(' differs from SI by ' || difference || '.', ' differs from the SI value.') AS explanation FROM ox_issue")
def cmp9(t):
    return I.issues_of(reports_with_results(t)).select("report_id", "explanation")


@query("cmp10_severity", "SELECT report_id, CASE WHEN field_name IN ('consignee','notify_party') THEN 'high' WHEN field_name IN ('gross_weight_kg','container_count') THEN 'med' ELSE 'low' END AS severity FROM fx_issues")
def cmp10(t):
    return I.issues_of(reports_with_results(t)).select("report_id", "severity")


@query("iss2_superseded", """SELECT i.report_id, CASE WHEN i.status IN ('OPEN','SUGGESTED','PENDING_APPROVAL') AND c.shipment_key IS NULL THEN 'SUPERSEDED' ELSE i.status END AS status
  FROM fx_issues i LEFT JOIN (SELECT DISTINCT shipment_key, field_name FROM fx_issues WHERE field_name <> 'consignee') c ON c.shipment_key = i.shipment_key AND c.field_name = i.field_name""")
def iss2(t):
    i = t.view("fx_issues")
    return I.supersede(i, i.filter("field_name <> 'consignee'")).select("report_id", "status")


step("ox_dec", "SELECT report_id AS decision_id, CAST(report_id - report_id % 3 AS VARCHAR) AS issue_key, CASE WHEN report_id % 2 = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS decision, updated_at AS decided_at FROM fx_reports")


@query("iss4_folded_decisions", """SELECT i.report_id, coalesce(d.decision, i.status) AS status FROM fx_issues i LEFT JOIN (
  SELECT issue_key, decision FROM (SELECT *, row_number() OVER (PARTITION BY issue_key ORDER BY decided_at DESC, decision_id DESC) AS r FROM ox_dec) x WHERE r = 1) d ON d.issue_key = CAST(i.report_id AS VARCHAR)""")
def iss4(t):
    r = F.col("report_id")
    dec = t.view("fx_reports").select(r.alias("decision_id"), (r - r % 3).cast("string").alias("issue_key"),
                                      F.when(r % 2 == 0, "APPROVED").otherwise("REJECTED").alias("decision"), F.col("updated_at").alias("decided_at"))
    return I.fold_decisions(t.view("fx_issues").withColumn("issue_key", r.cast("string")), dec).select("report_id", "status")


step("ox_group", "SELECT *, 'REF:' || CAST(report_id % 200 AS VARCHAR) AS g FROM fx_issues")
step("ox_resolution", """SELECT s.g AS shipment_key, count(i.report_id) AS total_issues, count(*) FILTER (WHERE i.status = 'APPROVED') AS resolved, count(*) FILTER (WHERE i.status IN ('SUGGESTED','PENDING_APPROVAL')) AS pending_approval,
  count(*) FILTER (WHERE i.status = 'REJECTED') AS rejected, count(*) FILTER (WHERE i.status = 'OPEN') AS "open"
  FROM (SELECT DISTINCT 'REF:' || CAST(report_id % 200 AS VARCHAR) AS g FROM fx_reports) s LEFT JOIN ox_group i ON i.g = s.g AND i.status <> 'SUPERSEDED' GROUP BY s.g""")


def grouped(t):
    g = F.concat(F.lit("REF:"), (F.col("report_id") % 200).cast("string"))
    return (t.view("fx_reports").select(g.alias("shipment_key")).distinct(), t.view("fx_issues").withColumn("shipment_key", g))


@query("iss5_resolution_status", """SELECT *, CASE WHEN total_issues = 0 THEN 'VERIFIED' WHEN resolved = total_issues THEN 'RESOLVED' WHEN pending_approval > 0 THEN 'PENDING_APPROVAL' ELSE 'NEEDS_REVIEW' END AS status FROM ox_resolution""")
def iss5(t):
    return I.resolution_status(*grouped(t))


@query("iss6_batch_approval", "SELECT report_id, CASE WHEN status IN ('OPEN','SUGGESTED','PENDING_APPROVAL') THEN 'APPROVED' ELSE status END AS status FROM fx_issues")
def iss6(t):
    return I.approve_all(t.view("fx_issues")).select("report_id", "status")


step("ox_bl", "SELECT m.email_id AS shipment_key, f.*  EXCLUDE (email_id), m.k FROM ox_fields f JOIN fx_emails m ON m.email_id = f.email_id WHERE f.doc_type = 'BL'")


@query("snk4_corrected_draft", """SELECT i.email_id AS shipment_key, 'email_' || i.report_id || '_BL_Corrected_v1.txt' AS draft_name,
  concat_ws(chr(10), 'GENERATED CORRECTED BL DRAFT', 'Shipment ID: ' || i.email_id, 'Source BL version: ' || i.report_id, 'Values approved by a reviewer replace those of the draft.', '', """
       + ", ".join(f"'{f}: ' || coalesce(CASE WHEN i.field_name = '{f}' THEN i.si_value END, {_s}, '')" for f in rules.COMPARED_FIELDS
                   for _s in [f"CASE WHEN b.{f} = floor(b.{f}) THEN CAST(CAST(b.{f} AS BIGINT) AS VARCHAR) ELSE CAST(b.{f} AS VARCHAR) END" if f == "gross_weight_kg" else f"CAST(b.{f} AS VARCHAR)"])
       + ") AS draft FROM fx_issues i JOIN ox_bl b ON b.shipment_key = i.email_id")
def snk4(t):
    bl = X.with_fields(t.docs.filter("doc_type = 'BL'"))
    bl = bl.select(F.col("email_id").alias("shipment_key"), F.col("path").alias("filename"), F.col("k").alias("version_id"), F.lit(1).alias("version_number"),
                   *[K.printed(F.col("fields")[f], f).alias(f) for f in rules.COMPARED_FIELDS])
    ok = t.view("fx_issues").select(F.col("email_id").alias("shipment_key"), F.col("report_id").alias("reg_id"), "field_name", F.col("si_value").alias("suggested_value"))
    return I.corrected_draft(bl, ok)


step("ox_review", """SELECT report_id AS review_id, 'email_' || CAST(report_id - report_id % 4 AS VARCHAR) AS email_id, CASE CAST(report_id % 3 AS INT) WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'CORRECT' ELSE 'REJECT' END AS decision FROM fx_reports""")


def reviews(t):
    r = F.col("report_id")
    return t.view("fx_reports").select(
        r.alias("review_id"), F.concat(F.lit("email_"), (r - r % 4).cast("string")).alias("email_id"),
        F.when(r % 3 == 0, "CONFIRM").when(r % 3 == 1, "CORRECT").otherwise("REJECT").alias("decision"))


@query("iss7_applied_reviews", """SELECT f.email_id, r.decision IS NOT NULL AS reviewed, CASE WHEN r.decision = 'CORRECT' THEN 'CORRECTED HOUSE' ELSE f.consignee END AS consignee,
    CASE WHEN r.decision = 'CORRECT' THEN 'GENERAL' ELSE 'BL_COMPARISON' END AS category
  FROM (SELECT * FROM ox_fields WHERE doc_type = 'BL') f LEFT JOIN (SELECT email_id, arg_max(decision, review_id) AS decision FROM ox_review GROUP BY email_id) r ON r.email_id = f.email_id""")
def iss7(t):
    bl = X.with_fields(t.docs.filter("doc_type = 'BL'")).select("email_id", F.col("fields").alias("bl_fields"), F.lit("BL_COMPARISON").alias("category"))
    rv = reviews(t).withColumn("corrected_fields", F.create_map(F.lit("consignee"), F.lit("CORRECTED HOUSE"))).withColumn("corrected_category", F.lit("GENERAL"))
    return I.apply_reviews(bl, rv).select("email_id", "reviewed", F.col("bl_fields.consignee").alias("consignee"), "category")


@query("iss8_review_override", """SELECT p.email_id, coalesce(o.s, p.status) AS status, CASE WHEN o.s IS NOT NULL THEN o.s = 'MISMATCH' ELSE p.has_defect END AS has_defect,
  CASE WHEN o.s IS NOT NULL AND o.s <> 'NEEDS_REVIEW' THEN NULL ELSE p.review_reason END AS review_reason, CASE WHEN o.s IS NOT NULL AND o.s <> 'MISMATCH' THEN '' ELSE coalesce(p.defect_field, '') END AS defect_fields
  FROM fx_reports p LEFT JOIN (SELECT email_id, arg_max(CASE WHEN decision = 'CONFIRM' THEN 'OK' ELSE 'MISMATCH' END, review_id) AS s FROM ox_review GROUP BY email_id) o ON o.email_id = p.email_id""")
def iss8(t):
    p = t.view("fx_reports").withColumn("defect_fields", F.array_compact(F.array("defect_field")))
    ov = reviews(t).select("email_id", "review_id", F.when(F.col("decision") == "CONFIRM", "OK").otherwise("MISMATCH").alias("new_status"), F.lit(None).cast("array<string>").alias("new_fields"))
    return I.override(p, ov).select("email_id", "status", "has_defect", "review_reason", F.array_join("defect_fields", ",").alias("defect_fields"))


@query("iss9_latest_reviews", "SELECT email_id, max(review_id) AS review_id, arg_max(decision, review_id) AS decision FROM ox_review GROUP BY email_id")
def iss9(t):
    return latest(reviews(t), ["email_id"], [F.col("review_id")])


@query("iss9b_review_history", "SELECT review_id, email_id, decision FROM ox_review ORDER BY review_id DESC")
def iss9b(t):
    return reviews(t).orderBy(F.col("review_id").desc())


_lab = "replace(replace(field_name, '_kg', ''), '_', ' ')"


@query("iss10_correction_mail", f"""SELECT report_id, 'BL draft differs from SI, shipment ' || split_part(shipment_key, ':', 2) AS subject,
  concat_ws(chr(10), 'Hello,', '', 'The shipping instruction and the bill of lading draft differ in these fields:', '', 'Shipment: ' || split_part(shipment_key, ':', 2), '',
   {_lab} || ':', 'SI: ' || si_value, 'BL: ' || bl_value, '', 'Please tell us which value is right. Nothing is changed until then.', '', 'Regards,') AS body FROM fx_issues""")
def iss10(t):
    return I.correction_mail(t.view("fx_issues")).select("report_id", "subject", "body")


step("ox_half_issue", f"SELECT *, {_diff} AS difference, coalesce(si_value, 'not provided') AS si, coalesce(bl_value, 'not provided') AS bl FROM fx_half_issues")


@query("iss11_assistance", f"""SELECT CAST(report_id AS VARCHAR) || ':' || field_name AS issue_key, 'The ' || {_lab} || ': the BL states ' || bl || ', the SI ' || si || '.' || coalesce(' They differ by ' || difference || '.', '') AS explanation,
  'Review the ' || {_lab} || '. Should the SI be right, the BL draft becomes ' || si || '.' AS suggestion, CASE WHEN si_value IS NULL OR bl_value IS NULL THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM ox_half_issue""")
def iss11(t):
    return I.assistance(I.issues_of(reports_with_results(t, "fx_half_issues")))


# -------------------------------------------------------------------- overview
step("ox_versions", """SELECT reg_id, shipment_key, doc_type, email_id, filename, 'ACTIVE' AS document_status, version_number, is_latest FROM ox_chain
  UNION ALL SELECT reg_id, shipment_key, doc_type, email_id, filename, 'DUPLICATE', 0, false FROM ox_dup WHERE duplicate_of IS NOT NULL""")
# Every fifth shipment lacks its instruction, which was filed under another key, where the draft is missing.
step("ox_ships", "SELECT 'REF:SHP-' || lpad(CAST(user_id AS VARCHAR),4,'0') AS shipment_key FROM events UNION SELECT shipment_key FROM fx_revisions")
step("ox_docs3", """SELECT s.shipment_key, k.doc_type, count(v.reg_id) FILTER (WHERE v.document_status = 'ACTIVE') AS version_count, max(v.version_number) FILTER (WHERE v.is_latest) AS current_version
  FROM ox_ships s CROSS JOIN (VALUES ('SI'), ('BL'), ('INVOICE')) k(doc_type) LEFT JOIN ox_versions v ON v.shipment_key = s.shipment_key AND v.doc_type = k.doc_type GROUP BY ALL""")


def ship_inputs(t):
    ships = t("events").select(F.concat(F.lit("REF:SHP-"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("shipment_key"))
    return ships.union(t.view("fx_revisions").select("shipment_key")).distinct(), register(t)


@query("ovr1_documents_per_shipment", "SELECT shipment_key, doc_type, version_count, current_version, version_count > 0 AS present FROM ox_docs3")
def ovr1(t):
    return O.documents(*ship_inputs(t))


step("ox_missing", """SELECT shipment_key, coalesce(string_agg(doc_type, ',' ORDER BY doc_type DESC) FILTER (WHERE version_count = 0 AND doc_type <> 'INVOICE'), '') AS missing_documents,
  coalesce(string_agg(doc_type, ',') FILTER (WHERE version_count = 0 AND doc_type = 'INVOICE'), '') AS missing_optional, count(*) FILTER (WHERE version_count = 0 AND doc_type <> 'INVOICE') = 0 AS complete, max(version_count) > 0 AS has_any FROM ox_docs3 GROUP BY shipment_key""")


@query("ovr2_missing_types", "SELECT * FROM ox_missing")
def ovr2(t):
    m = O.missing_types(O.documents(*ship_inputs(t)))
    return m.withColumn("missing_documents", F.array_join("missing_documents", ",")).withColumn("missing_optional", F.array_join("missing_optional", ","))


step("ox_rep", """SELECT shipment_key, report_id, category, status, review_reason FROM (SELECT v.shipment_key, r.report_id, r.category, r.status, r.review_reason,
  row_number() OVER (PARTITION BY v.shipment_key ORDER BY (r.category = 'BL_COMPARISON') DESC, r.report_id DESC) AS n FROM ox_versions v JOIN fx_reports r ON r.email_id = v.email_id) x WHERE n = 1""")


@query("ovr3_representative_report", "SELECT * FROM ox_rep")
def ovr3(t):
    return O.representative_report(register(t), t.view("fx_reports")).drop("has_defect")


step("ox_shipissue", "SELECT DISTINCT 'REF:SHP-' || lpad(CAST(report_id % 300 AS VARCHAR),4,'0') AS shipment_key, field_name, report_id, status FROM fx_issues")
step("ox_over", """SELECT m.*, coalesce(i.f, '') AS mismatch_fields, coalesce(i.n, 0) AS issue_count, r.status AS report_status, r.review_reason AS report_reason FROM ox_missing m
  LEFT JOIN (SELECT shipment_key, string_agg(DISTINCT field_name, ', ' ORDER BY field_name) AS f, count(*) AS n FROM ox_shipissue WHERE status <> 'SUPERSEDED' GROUP BY shipment_key) i ON i.shipment_key = m.shipment_key
  LEFT JOIN ox_rep r ON r.shipment_key = m.shipment_key""")
step("ox_status", """SELECT *, CASE WHEN NOT has_any THEN 'PROCESSING' WHEN contains(missing_documents, 'SI') THEN 'INCOMPLETE' WHEN missing_documents <> '' OR mismatch_fields <> '' OR coalesce(report_status = 'NEEDS_REVIEW', false) THEN 'NEEDS_ATTENTION' ELSE 'VERIFIED' END AS status FROM ox_over""")


def overview(t):
    ships, versions = ship_inputs(t)
    key = F.concat(F.lit("REF:SHP-"), F.lpad((F.col("report_id") % 300).cast("string"), 4, "0"))
    return O.overview(ships, versions, t.view("fx_issues").withColumn("shipment_key", key), t.view("fx_reports"))


@query("ovr4_shipment_status", "SELECT shipment_key, status, issue_count FROM ox_status")
def ovr4(t):
    return overview(t).select("shipment_key", "status", "issue_count")


# The same from a maintained table: all issues come as suggested and without reports first, their true status and the other half later.
@query("ovr4m_maintained_status", "SELECT shipment_key, status, issue_count, mismatch_fields FROM ox_status")
def ovr4m(t):
    ships, versions = ship_inputs(t)
    out = J.work_dir(t.spark) + "/overview"
    issues = t.view("fx_issues").select(F.concat_ws(":", "report_id", "field_name").alias("issue_key"), F.concat(F.lit("REF:SHP-"), F.lpad((F.col("report_id") % 300).cast("string"), 4, "0")).alias("shipment_key"), "field_name", "status")
    MO.maintain(t.spark, out, 0, ships, versions.filter("reg_id % 2 = 0"), issues.withColumn("status", F.lit("SUGGESTED")))
    MO.maintain(t.spark, out, 1, None, versions.filter("reg_id % 2 = 1"), issues.filter("status <> 'SUGGESTED'"), t.view("fx_reports"))
    return MO.current(t.spark, out).select("shipment_key", "status", "issue_count", F.array_join("mismatch_fields", ", ").alias("mismatch_fields"))


@query("ovr5_reasons", """SELECT shipment_key, concat_ws('; ', CASE WHEN contains(missing_documents, 'SI') THEN 'Missing Shipping Instruction' END, CASE WHEN contains(missing_documents, 'BL') THEN 'Missing Bill of Lading' END,
  CASE WHEN mismatch_fields <> '' THEN 'Field mismatch: ' || mismatch_fields END, CASE WHEN report_status = 'NEEDS_REVIEW' THEN 'Needs review: ' || report_reason END) AS reasons FROM ox_status""")
def ovr5(t):
    return overview(t).select("shipment_key", F.array_join("reasons", "; ").alias("reasons"))


@query("ovr6_actions", """SELECT shipment_key, concat_ws(',', CASE WHEN contains(missing_documents, 'BL') THEN 'REQUEST_BL' END, CASE WHEN contains(missing_documents, 'SI') THEN 'REQUEST_SI' END, CASE WHEN mismatch_fields <> '' THEN 'REQUEST_CORRECTION' END,
  CASE WHEN report_status = 'NEEDS_REVIEW' THEN 'MANUAL_REVIEW' END, CASE WHEN status = 'VERIFIED' THEN 'NO_ACTION' END) AS actions FROM ox_status""")
def ovr6(t):
    return overview(t).select("shipment_key", F.array_join("actions", ",").alias("actions"))


@query("ovr7_source_mails", """SELECT v.shipment_key, v.email_id, string_agg(v.filename, ',' ORDER BY v.filename) AS files, string_agg(DISTINCT v.doc_type, ',' ORDER BY v.doc_type) AS document_types, any_value(m.sender) AS sender
  FROM ox_versions v LEFT JOIN fx_emails m ON m.email_id = v.email_id GROUP BY v.shipment_key, v.email_id""")
def ovr7(t):
    return O.source_mails(register(t), t.mails).select("shipment_key", "email_id", F.array_join("files", ",").alias("files"), F.array_join("document_types", ",").alias("document_types"), "sender")


step("ox_summary", """SELECT s.*, coalesce(c.t, 0) AS mismatch_count, coalesce(c.r, 0) AS resolved_count, coalesce(c.p, 0) AS pending_count FROM ox_status s LEFT JOIN (SELECT shipment_key, count(*) AS t, count(*) FILTER (WHERE status = 'APPROVED') AS r,
  count(*) FILTER (WHERE status IN ('SUGGESTED','PENDING_APPROVAL')) AS p FROM ox_shipissue WHERE status <> 'SUPERSEDED' GROUP BY shipment_key) c ON c.shipment_key = s.shipment_key""")


def summary(t):
    key = F.concat(F.lit("REF:SHP-"), F.lpad((F.col("report_id") % 300).cast("string"), 4, "0"))
    o = overview(t)
    c = I.resolution_status(o, t.view("fx_issues").withColumn("shipment_key", key)).select(
        "shipment_key", F.col("total_issues").alias("mismatch_count"), F.col("resolved").alias("resolved_count"), F.col("pending_approval").alias("pending_count"))
    return o.join(c, "shipment_key", "left")


@query("ovr8_shipment_summary", "SELECT s.shipment_key, s.status, mismatch_count, resolved_count, pending_count, l.si_content, l.bl_content FROM ox_summary s LEFT JOIN (SELECT shipment_key, max(content) FILTER (WHERE doc_type = 'SI') AS si_content, max(content) FILTER (WHERE doc_type = 'BL') AS bl_content FROM ox_chain WHERE is_latest GROUP BY shipment_key) l ON l.shipment_key = s.shipment_key")
def ovr8(t):
    pair = V.latest_pairs(V.with_duplicates(regs(t)).filter("document_status = 'ACTIVE'"), "content")
    return summary(t).join(pair, "shipment_key", "left").select("shipment_key", "status", "mismatch_count", "resolved_count", "pending_count", "si_content", "bl_content")


step("ox_work", """SELECT *, CASE WHEN resolved_count > 0 THEN 'Resolved' WHEN pending_count > 0 THEN 'Pending' WHEN mismatch_count > 0 THEN 'Unresolved' ELSE 'Clear' END AS resolution,
  status = 'NEEDS_ATTENTION' OR mismatch_count > 0 OR missing_documents <> '' OR coalesce(report_status = 'NEEDS_REVIEW', false) AS needs_attention, mismatch_count > 0 AS mismatch,
  coalesce(report_status = 'NEEDS_REVIEW', false) AS needs_review, resolved_count > 0 AS is_resolved FROM ox_summary""")


@query("flt5_worklist", "SELECT shipment_key, needs_attention, mismatch, needs_review, is_resolved FROM ox_work")
def flt5(t):
    return O.work_flags(summary(t)).select("shipment_key", "needs_attention", "mismatch", "needs_review", "is_resolved")


@query("ovr9_dashboard", "SELECT count(*) AS all_shipments, count(*) FILTER (WHERE needs_attention) AS needs_attention, count(*) FILTER (WHERE mismatch) AS mismatch, count(*) FILTER (WHERE needs_review) AS needs_review, count(*) FILTER (WHERE is_resolved) AS resolved FROM ox_work")
def ovr9(t):
    return O.dashboard(O.work_flags(summary(t)))


@query("ovr10_resolution_label", "SELECT shipment_key, resolution, CASE resolution WHEN 'Resolved' THEN 4 WHEN 'Pending' THEN 3 WHEN 'Unresolved' THEN 2 ELSE 1 END AS resolution_rank FROM ox_work")
def ovr10(t):
    return O.work_flags(summary(t)).select("shipment_key", "resolution", O.resolution_rank(F.col("resolution")).alias("resolution_rank"))


@query("ovr11_trade_lane", """SELECT email_id, CASE WHEN coalesce(port_of_loading, port_of_discharge) IS NOT NULL THEN coalesce(port_of_loading, '?') || ' → ' || coalesce(port_of_discharge, '?') ELSE coalesce(shipper, consignee, '') END AS lane FROM ox_fields WHERE doc_type = 'BL'""")
def ovr11(t):
    f = X.with_fields(t.docs.filter("doc_type = 'BL'"))
    c = lambda n: F.col("fields")[n]
    return f.select("email_id", O.trade_lane(c("port_of_loading"), c("port_of_discharge"), c("shipper"), c("consignee")).alias("lane"))
