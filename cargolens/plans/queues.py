"""Lists, counters and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..operators import queues as Q
from .gateway import assignments
from .registry import query, step

FIELDS = "array_compact(array(defect_field))"


def reports(t):
    return t.view("fx_reports")


@query("flt1_report_list", "SELECT report_id, email_id, total FROM (SELECT report_id, email_id, count(*) OVER () AS total, row_number() OVER (ORDER BY report_id) AS n FROM fx_reports WHERE status = 'MISMATCH' AND has_defect) x WHERE n > 5 AND n <= 55")
def flt1(t):
    f = Q.report_filter(reports(t), status="MISMATCH", has_defect=True).select("report_id", "email_id")
    return Q.with_total(Q.page(f, [F.col("report_id")], 5, 50), f)


@query("flt2_mail_search", "SELECT email_id FROM fx_emails WHERE contains(lower(email_id || ' ' || sender || ' ' || subject), 'partner3.com to')")
def flt2(t):
    return t.mails.filter(Q.found_in("Partner3.com TO", F.col("email_id"), F.col("sender"), F.col("subject"))).select("email_id")


@query("flt2b_document_search", "SELECT doc_id FROM documents WHERE contains(lower(text || ' ' || source), 'the')")
def flt2b(t):
    return t("documents").filter(Q.found_in("the", F.col("text"), F.col("source"))).select("doc_id")


@query("flt3_reply_queue", "SELECT email_id FROM fx_enriched WHERE source_mailbox = 'DOCS' AND reply_state = 'awaiting' AND contains(lower(concat_ws(' ', email_id, sender, subject, source_mailbox, category, status, defect_fields)), 'consignee')")
def flt3(t):
    return Q.reply_queue(t.view("fx_enriched"), "DOCS", "reply", "Consignee").select("email_id")


_ing = "SELECT 'ingested' AS origin, 'STG-' || email_id AS stage_id, 'OPS' AS source_mailbox, sender, subject, coalesce(body, '') AS body, 'AUTO_INGESTED' AS status, received_at AS created_at, k AS id FROM fx_emails"
_stg = "SELECT 'staged' AS origin, stage_id, source_mailbox, sender, subject, coalesce(body, '') AS body, status, created_at, id FROM fx_staged"


def staged_union(t):
    ing = t.view("fx_emails").select(F.concat(F.lit("STG-"), F.col("email_id")).alias("stage_id"), F.lit("OPS").alias("source_mailbox"), "sender", "subject", "body",
                                     F.col("received_at").alias("created_at"), F.col("k").alias("id"))
    return Q.staging_list(t.view("fx_staged"), ing)


@query("flt4_staging_list", f"SELECT * FROM (SELECT * FROM ({_stg} UNION ALL {_ing}) x WHERE source_mailbox = 'OPS') y ORDER BY origin DESC, id DESC")
def flt4(t):
    return staged_union(t).filter("source_mailbox = 'OPS'").orderBy(F.col("origin").desc(), F.col("id").desc())


@query("set1_tagged_union", f"SELECT origin, status, count(*) AS n FROM ({_stg} UNION ALL {_ing}) x GROUP BY ALL")
def set1(t):
    return staged_union(t).groupBy("origin", "status").agg(F.count(F.lit(1)).alias("n"))


CODES = """SELECT 'SHP-' || lpad(CAST(c_custkey AS STRING),6,'0') AS code FROM customer UNION ALL SELECT 'ref:shp-' || lpad(CAST(s_suppkey AS STRING),6,'0') FROM supplier UNION ALL SELECT lpad(CAST(n_nationkey AS STRING),6,'0') FROM nation"""
step("ox_codes", f"SELECT DISTINCT code FROM ({CODES}) x")


@query("flt6_shipment_lookup", """SELECT c.code, coalesce(min(CASE WHEN s.shipment_key = c.code THEN '0' || s.shipment_key WHEN s.shipment_key = 'REF:' || upper(c.code) THEN '1' || s.shipment_key WHEN s.shipment_key = upper(c.code) THEN '2' || s.shipment_key
   WHEN s.shipment_key = 'REF:' || c.code THEN '3' || s.shipment_key WHEN s.shipment_key IS NOT NULL THEN '9' || s.shipment_key END)[2:], NULL) AS shipment_key
  FROM ox_codes c LEFT JOIN fx_reports s ON ends_with(lower(s.shipment_key), lower(c.code)) GROUP BY c.code""")
def flt6(t):
    return Q.shipment_lookup(reports(t).select("shipment_key").distinct(), t.sql(CODES).distinct())


WANTED = "SELECT CAST(c_custkey AS STRING) AS ref FROM customer UNION ALL SELECT 'email_' || CAST(c_custkey + 3 AS STRING) FROM customer"
step("ox_wanted", WANTED)


@query("flt7_report_lookup", "SELECT w.ref, coalesce(a.report_id, b.report_id) AS report_id FROM ox_wanted w LEFT JOIN fx_reports a ON a.report_id = try_cast(w.ref AS BIGINT) LEFT JOIN fx_reports b ON b.email_id = w.ref")
def flt7(t):
    return Q.report_lookup(reports(t), t.sql(WANTED))


@query("flt8_origin_mailbox", "SELECT email_id, CASE WHEN starts_with(email_id, 'email_') OR starts_with(email_id, '520') THEN 'BUNDLE' ELSE 'OPS' END AS mailbox FROM fx_all_mails")
def flt8(t):
    return t.view("fx_all_mails").select("email_id", Q.origin_mailbox(F.col("email_id"), "BUNDLE", "OPS").alias("mailbox"))


@query("flt9_safe_segment", "SELECT id, coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(name, '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'file') AS segment FROM fx_files")
def flt9(t):
    return t.view("fx_files").select("id", Q.safe_segment(F.col("name"), "file").alias("segment"))


@query("flt11_shipment_search", "SELECT shipment_key FROM (SELECT shipment_key, min(filename) AS f FROM fx_regs GROUP BY ALL) x WHERE contains(lower(shipment_key || ' ' || f), 'shp-00') ORDER BY shipment_key")
def flt11(t):
    s = t.view("fx_regs").groupBy("shipment_key").agg(F.min("filename").alias("si_filename"))
    s = s.withColumn("reference_number", F.lit(None).cast("string")).withColumn("bl_filename", F.lit(None).cast("string"))
    return Q.shipment_search(s, "SHP-00").select("shipment_key")


# -------------------------------------------------------------------- counters
@query("agg1_report_stats", "SELECT 'status' AS dim, status AS value, count(*) AS n FROM fx_reports GROUP BY status UNION ALL SELECT 'category', category, count(*) FROM fx_reports GROUP BY category UNION ALL SELECT 'defect_field', defect_field, count(*) FROM fx_reports WHERE defect_field IS NOT NULL GROUP BY defect_field")
def agg1(t):
    return Q.report_stats(reports(t).withColumn("defect_fields", F.expr(FIELDS)))


@query("agg2_inbox_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE reviewed) AS reviewed, count(*) FILTER (WHERE status = 'OK') AS ok, count(*) FILTER (WHERE status = 'MISMATCH') AS mismatch, count(*) FILTER (WHERE status = 'NEEDS_REVIEW') AS needs_review FROM fx_reports")
def agg2(t):
    return Q.counters(reports(t), reviewed="reviewed", ok="status = 'OK'", mismatch="status = 'MISMATCH'", needs_review="status = 'NEEDS_REVIEW'")


_rank = "CASE reason " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(rules.REVIEW_ORDER)) + " ELSE 99 END"
_label = "CASE reason " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules.REVIEW_LABELS.items()) + " ELSE reason END"


@query("agg3_review_queue", f"SELECT email_id, reason, CAST({_rank} AS INT) AS bucket_rank, {_label} AS label, count(*) OVER (PARTITION BY reason) AS bucket_size FROM (SELECT email_id, coalesce(review_reason, 'unknown') AS reason FROM fx_reports WHERE status = 'NEEDS_REVIEW') x")
def agg3(t):
    return Q.review_queue(reports(t)).select("email_id", "reason", "bucket_rank", "label", "bucket_size")


@query("agg4_run_counters", "SELECT status, category, count(*) AS n, count(*) FILTER (WHERE status = 'ERROR') AS failed FROM fx_reports GROUP BY ALL")
def agg4(t):
    return reports(t).groupBy("status", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ERROR").alias("failed"))


@query("agg5_gateway_statistics", "SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('AUTO_INGESTED','APPROVED')) AS safe, count(*) FILTER (WHERE security_status = 'BLOCKED') AS blocked, count(*) FILTER (WHERE category = 'SPAM' OR status = 'QUARANTINED') AS quarantined, count(*) FILTER (WHERE status = 'STAGED') AS pending FROM fx_staged")
def agg5(t):
    return Q.counters(t.view("fx_staged"), safe="status IN ('AUTO_INGESTED','APPROVED')", blocked="security_status = 'BLOCKED'", quarantined="category = 'SPAM' OR status = 'QUARANTINED'", pending="status = 'STAGED'")


@query("agg6_backlog_per_mailbox", "SELECT d.source_mailbox, count(s.id) AS n FROM (SELECT DISTINCT source_mailbox FROM fx_staged UNION SELECT n_name FROM nation) d LEFT JOIN fx_staged s ON s.source_mailbox = d.source_mailbox AND s.status = 'STAGED' GROUP BY ALL")
def agg6(t):
    s = t.view("fx_staged")
    dim = s.select("source_mailbox").unionByName(t("nation").select(F.col("n_name").alias("source_mailbox")))
    return Q.zero_filled(dim, s.filter("status = 'STAGED'"), "source_mailbox")


step("ox_console", "SELECT r.*, a.assignment FROM fx_reports r JOIN ox_assign a ON a.email_id = r.email_id")


@query("agg7_console_kpis", "SELECT count(*) AS total, count(*) FILTER (WHERE assignment = 'HOLD') AS awaiting, count(*) FILTER (WHERE status = 'MISMATCH') AS mismatch, count(*) FILTER (WHERE assignment = 'AUTO') AS auto, count(*) FILTER (WHERE assignment = 'IGNORE') AS ignored, count(*) FILTER (WHERE category = 'BL_COMPARISON') AS listed FROM ox_console")
def agg7(t):
    rows = reports(t).join(assignments(t).select("email_id", "assignment"), "email_id")
    return Q.counters(rows, awaiting="assignment = 'HOLD'", mismatch="status = 'MISMATCH'", auto="assignment = 'AUTO'", ignored="assignment = 'IGNORE'", listed="category = 'BL_COMPARISON'")


@query("agg8_assignment_tally", "SELECT d.assignment, count(a.email_id) AS n FROM (VALUES ('AUTO'), ('HOLD'), ('IGNORE'), ('OTHER')) d(assignment) LEFT JOIN ox_assign a ON a.assignment = d.assignment GROUP BY ALL")
def agg8(t):
    dim = t.sql("SELECT explode(array('AUTO', 'HOLD', 'IGNORE', 'OTHER')) AS assignment")
    return Q.zero_filled(dim, assignments(t), "assignment")


@query("agg8b_reason_tally", "SELECT review_reason, count(*) AS n FROM fx_reports WHERE review_reason IS NOT NULL GROUP BY ALL")
def agg8b(t):
    return Q.tally(reports(t), "review_reason")


_rk = "count(*) AS total, count(*) FILTER (WHERE reply_state = 'awaiting') AS awaiting, count(*) FILTER (WHERE reply_state = 'sent') AS sent, count(*) FILTER (WHERE status IN ('MISMATCH','NEEDS_REVIEW') AND disposition = 'manual') AS review"


def reply_kpis(t):
    return Q.counters(t.view("fx_enriched"), awaiting="reply_state = 'awaiting'", sent="reply_state = 'sent'", review="status IN ('MISMATCH','NEEDS_REVIEW') AND disposition = 'manual'")


@query("agg9_reply_kpis", f"SELECT {_rk} FROM fx_enriched")
def agg9(t):
    return reply_kpis(t)


@query("agg10_mailboxes", "SELECT DISTINCT source_mailbox FROM fx_enriched ORDER BY 1")
def agg10(t):
    return t.view("fx_enriched").select("source_mailbox").distinct().orderBy("source_mailbox")


@query("agg11_field_counters", "SELECT email_id, count(*) FILTER (WHERE match = 'MATCH') AS ok, count(*) FILTER (WHERE match IN ('DIFF','POSSIBLE')) AS differ, count(*) FILTER (WHERE match = 'UNDECIDABLE') AS missing FROM ox_pair_long GROUP BY email_id")
def agg11(t):
    from .extraction import pairs
    n = lambda *v: F.size(F.filter("field_results", lambda r: r["match"].isin(*v))).cast("bigint")
    return pairs(t).select("email_id", n("MATCH").alias("ok"), n("DIFF", "POSSIBLE").alias("differ"), n("UNDECIDABLE").alias("missing"))


@query("agg12_heat", "SELECT email_id, CASE status WHEN 'MISMATCH' THEN 'bad' WHEN 'NEEDS_REVIEW' THEN 'warn' WHEN 'OK' THEN 'ok' ELSE 'skip' END AS tone, CASE status WHEN 'MISMATCH' THEN least(0.78 + 0.09 * (defect_field IS NOT NULL)::INT, 1.0) WHEN 'NEEDS_REVIEW' THEN 0.82 WHEN 'OK' THEN 0.78 ELSE 0.45 END::DOUBLE AS intensity FROM fx_reports")
def agg12(t):
    h = Q.heat(F.col("status"), F.when(F.col("defect_field").isNotNull(), 1).otherwise(0))
    return reports(t).select("email_id", h.alias("h")).select("email_id", "h.tone", "h.intensity")


@query("agg13_shares", "SELECT total, CAST(floor(ok * 100.0 / total + 0.5) AS BIGINT) AS ok_pct, CAST(floor(mm * 100.0 / total + 0.5) AS BIGINT) AS mismatch_pct, CAST(floor(nr * 100.0 / total + 0.5) AS BIGINT) AS needs_review_pct, total - ok - mm - nr AS other FROM (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'OK') AS ok, count(*) FILTER (WHERE status = 'MISMATCH') AS mm, count(*) FILTER (WHERE status = 'NEEDS_REVIEW') AS nr FROM fx_reports) x")
def agg13(t):
    c = Q.counters(reports(t), ok="status = 'OK'", mismatch="status = 'MISMATCH'", needs_review="status = 'NEEDS_REVIEW'")
    return Q.shares(c, ["ok", "mismatch", "needs_review"])


@query("agg14_sender_domains", "SELECT split_part(sender, '@', -1) AS domain, count(*) AS n FROM fx_emails GROUP BY ALL ORDER BY n DESC, domain LIMIT 5")
def agg14(t):
    return Q.top_values(t.mails.select(F.substring_index("sender", "@", -1).alias("domain")), "domain", 5)


@query("agg14b_keywords_per_bucket", "SELECT status, count(*) FILTER (WHERE contains(lower(subject), 'docs')) AS docs, count(*) FILTER (WHERE contains(lower(subject), 'si needed')) AS si_needed, count(*) FILTER (WHERE contains(lower(subject), 'invoice')) AS invoice FROM fx_enriched GROUP BY status")
def agg14b(t):
    has = lambda w: F.count_if(F.contains(F.lower("subject"), F.lit(w)))
    return t.view("fx_enriched").groupBy("status").agg(has("docs").alias("docs"), has("si needed").alias("si_needed"), has("invoice").alias("invoice"))


@query("agg15_process_status", """SELECT m.email_id, r.email_id IS NOT NULL AS processed, CASE WHEN r.email_id IS NULL THEN 'PENDING' WHEN status = 'DEAD_LETTER' THEN 'DEAD' WHEN status = 'ERROR' THEN 'FAILED' WHEN status = 'NEEDS_REVIEW' THEN 'NEEDS_HUMAN' ELSE 'COMPLETED' END AS state,
  CASE WHEN category IS NULL THEN 'pending' WHEN category <> 'BL_COMPARISON' THEN 'classified (non-comparison)' WHEN status = 'NEEDS_REVIEW' THEN 'escalated: ' || coalesce(review_reason, 'needs review') WHEN status = 'DEAD_LETTER' THEN 'dead letter after ' || attempts || ' attempts'
  WHEN status = 'ERROR' THEN 'failed during processing' WHEN reviewed THEN 'completed (human-reviewed)' ELSE 'completed' END AS stage FROM fx_all_mails m LEFT JOIN fx_reports r ON r.email_id = m.email_id""")
def agg15(t):
    return Q.process_status(t.view("fx_all_mails"), reports(t))


@query("agg16_need_counts", "SELECT (SELECT count(*) FROM fx_staged WHERE status = 'STAGED') AS triage, count(*) FILTER (WHERE status = 'NEEDS_REVIEW') AS review, count(*) FILTER (WHERE reply_state = 'awaiting') AS reply, count(*) FILTER (WHERE reply_state = 'failed') AS failed FROM fx_enriched")
def agg16(t):
    a = t.view("fx_staged").agg(F.count_if(F.col("status") == "STAGED").alias("triage"))
    return a.crossJoin(Q.counters(t.view("fx_enriched"), review="status = 'NEEDS_REVIEW'", reply="reply_state = 'awaiting'", failed="reply_state = 'failed'").drop("total"))


# --------------------------------------------------------------- order and sets
@query("srt1_newest_dispatches", "SELECT dispatch_id, delivery FROM fx_dispatches ORDER BY dispatch_id DESC LIMIT 50")
def srt1(t):
    return Q.page(t.view("fx_dispatches").select("dispatch_id", "delivery"), [F.col("dispatch_id").desc()], 0, 50)


@query("srt2_arrival_order", "SELECT reg_id, received_at FROM fx_revisions ORDER BY received_at IS NOT NULL, received_at, reg_id")
def srt2(t):
    return Q.arrival_order(t.view("fx_revisions").select("reg_id", "received_at"), "received_at", "reg_id")


@query("srt3_offset_page", "SELECT email_id, total FROM (SELECT email_id, count(*) OVER () AS total, row_number() OVER (ORDER BY email_id) AS n FROM fx_emails) x WHERE n > 100 AND n <= 150")
def srt3(t):
    m = t.mails.select("email_id")
    return Q.with_total(Q.page(m, [F.col("email_id")], 100, 50), m)


@query("set2_owned_ids", "SELECT r.email_id, m.email_id IS NOT NULL AS owned FROM (SELECT DISTINCT 'email_' || CAST(event_id AS VARCHAR) AS email_id FROM events) r LEFT JOIN fx_emails m ON m.email_id = r.email_id")
def set2(t):
    return Q.owned_split(t("events").select(F.concat(F.lit("email_"), F.col("event_id").cast("string")).alias("email_id")), t.mails)


@query("set3_lost_fields", "SELECT s.email_id, concat_ws(',', " + ", ".join(f"CASE WHEN s.{f} IS NOT NULL AND b.{f} IS NULL THEN '{f}' END" for f in sorted(rules.ALL_FIELDS)) + ") AS lost FROM ox_fields s JOIN ox_fields b ON b.email_id = s.email_id AND b.doc_type = 'BL' WHERE s.doc_type = 'SI'")
def set3(t):
    from ..operators import extract as X
    names = lambda f: F.array_compact(F.array(*[F.when(f[n].isNotNull(), F.lit(n)) for n in rules.ALL_FIELDS]))
    f = X.with_fields(t.docs).select("email_id", "doc_type", names(F.col("fields")).alias("n"))
    s, b = f.filter("doc_type = 'SI'").select("email_id", F.col("n").alias("s")), f.filter("doc_type = 'BL'").select("email_id", F.col("n").alias("b"))
    return s.join(b, "email_id").select("email_id", F.array_join(Q.field_set_difference(F.col("s"), F.col("b")), ",").alias("lost"))
