"""Sources, sinks and the remaining scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..operators import compare as K, extract as X
from ..sources import documents as S, mail as M
from . import duck as D
from .extraction import long_results, pairs
from .mails import all_mails
from .registry import query, step

RAW = """SELECT CASE WHEN c_custkey % 4 = 0 THEN 'c' || CAST(c_custkey AS STRING) END AS email_id, CASE WHEN c_custkey % 4 = 1 THEN 'i' || CAST(c_custkey AS STRING) END AS id, CASE WHEN c_custkey % 4 = 2 THEN 'm' || CAST(c_custkey AS STRING) END AS message_id,
  'stem' || CAST(c_custkey AS STRING) AS stem, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS sender, c_mktsegment AS `from`, '' AS email, c_name AS subject, CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE '' END AS body, 'txt' AS text, 'cnt' AS content,
  CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN '["a.txt","b.txt"]' WHEN 1 THEN 'one.pdf' END AS attachments, '' AS files, '2024-03-05T10:00:00+02:00' AS received_at, '' AS `timestamp`, '' AS `date` FROM customer"""


@query("src2_mail_keys", """SELECT coalesce(CASE c_custkey % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'i' WHEN 2 THEN 'm' ELSE 'stem' END) || c_custkey AS email_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS sender,
  CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'txt' END AS body, CASE c_custkey % 3 WHEN 0 THEN 'a.txt,b.txt' WHEN 1 THEN 'one.pdf' ELSE '' END AS attachments, TIMESTAMP '2024-03-05 08:00:00' AS received_at FROM customer""")
def src2(t):
    return M.normalise_mail(t.sql(RAW)).select("email_id", "sender", "body", F.array_join("attachments", ",").alias("attachments"), "received_at")


@query("src3_insert_new", "SELECT email_id FROM fx_all_mails WHERE email_id NOT IN (SELECT email_id FROM fx_emails)")
def src3(t):
    return M.insert_new(t.mails, all_mails(t)).select("email_id")


@query("src5_inbox", "SELECT email_id FROM fx_talk UNION ALL SELECT email_id FROM fx_emails")
def src5(t):
    a = all_mails(t)
    return M.inbox(a.filter("email_id LIKE 'T%'"), a).select("email_id")


@query("src6_mail_lookup", "SELECT w.email_id, coalesce(a.subject, b.subject) AS subject, CASE WHEN a.email_id IS NOT NULL THEN 'first' WHEN b.email_id IS NOT NULL THEN 'second' END AS found_in FROM (SELECT DISTINCT 'email_' || CAST(event_id AS VARCHAR) AS email_id FROM events) w LEFT JOIN (SELECT * FROM fx_emails WHERE f_odd) a ON a.email_id = w.email_id LEFT JOIN fx_emails b ON b.email_id = w.email_id".replace("WHERE f_odd", "WHERE k % 2 = 1"))
def src6(t):
    w = t("events").select(F.concat(F.lit("email_"), F.col("event_id").cast("string")).alias("email_id")).distinct()
    return M.lookup(w, t.mails.filter("k % 2 = 1"), t.mails).select("email_id", "subject", "found_in")


# Nested ten deep, a list of thirty items, a value over two lines.
JSON = """SELECT s_suppkey AS doc, '{"data": {"ShipperName": "' || s_name || '", "gross_weight": ' || CAST(s_suppkey * 1234 AS STRING) || ', "flag": true, "ports": [' || array_join(transform(sequence(1, 30), x -> '"P' || x || '"'), ', ')
  || '], "legs": [{"PortOfLoading": "P' || CAST(s_nationkey AS STRING) || '"}, {"PortOfLoading": "Q"}], "Address": "Road 1\\\\nTown", "a1": {"b2": {"c3": {"d4": {"e5": {"f6": {"g7": {"DeepName": "x' || s_suppkey || '"}}}}}}}}}' AS text FROM supplier"""


@query("src7_json_fields", """SELECT s_suppkey AS doc, 'Shipper Name' AS label, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'gross weight', format('{:,}', s_suppkey * 1234) FROM supplier
  UNION ALL SELECT s_suppkey, 'ports', array_to_string(list_transform(range(1, 31), lambda x: 'P' || x), ', ') FROM supplier UNION ALL SELECT s_suppkey, 'legs Port Of Loading', 'P' || s_nationkey FROM supplier UNION ALL SELECT s_suppkey, 'legs Port Of Loading', 'Q' FROM supplier
  UNION ALL SELECT s_suppkey, 'Address', unnest(['Road 1', 'Town']) FROM supplier UNION ALL SELECT s_suppkey, 'a1 b2 c3 d4 e5 f6 g7 Deep Name', 'x' || s_suppkey FROM supplier""")
def src7(t):
    return S.flatten_json(t.sql(JSON).select("doc", F.parse_json("text").alias("v")))


@query("src8_json_lines", "SELECT user_id AS doc, count(*) AS records FROM events GROUP BY ALL")
def src8(t):
    line = t("events").select(F.col("event_id").alias("doc"), "user_id", F.concat(F.col("props"), F.lit(",\n{broken\n[\n")).alias("text"))
    return S.json_lines(line).join(line.select("doc", "user_id"), "doc").groupBy(F.col("user_id").alias("doc")).agg(F.count(F.lit(1)).alias("records"))


@query("src9_csv_lines", "SELECT p_partkey AS doc, 'Shipper | ' || p_name || ', LTD' || chr(10) || 'Size | ' || p_size AS text FROM part")
def src9(t):
    raw = F.concat(F.lit('Shipper,"'), F.col("p_name"), F.lit(', LTD",\n,,\n Size ,,'), F.col("p_size").cast("string"))
    return t("part").select(F.col("p_partkey").alias("doc"), S.csv_lines(raw).alias("text"))


@query("src10_xml_lines", "SELECT p_partkey AS doc, 'Shipper | ' || p_name || chr(10) || 'Port Of Loading | ' || p_brand || chr(10) || 'Remark | mixed' || chr(10) || 'Inner | a & b' || chr(10) || 'Note | 1 < 2 & x' AS text FROM part")
def src10(t):
    raw = F.concat(F.lit("<?xml version='1.0'?><!-- <Shipper>no</Shipper> --><doc a='1'>\n <n:Shipper>"), F.col("p_name"), F.lit("</n:Shipper><PortOfLoading x='y'> "), F.col("p_brand"),
                   F.lit("\n</PortOfLoading><e></e><Remark>mixed<Inner>a &amp; b</Inner></Remark><Note><![CDATA[1 < 2 & x]]></Note></doc>"))
    return t("part").select(F.col("p_partkey").alias("doc"), S.xml_lines(raw).alias("text"))


@query("src11_edifact", """SELECT s_suppkey AS doc, concat_ws(chr(10), 'Shipper | ' || s_name || ' + CO', 'PORT ROAD', 'Port of Loading | PORT ' || s_nationkey || ' (ABCDE)', 'Gross Weight (KG) | ' || format('{:,.2f}', s_suppkey * 1000.0) || ' KG', 'ETD | 2026-03-20', 'Consignee: ' || s_name, 'Container Count | 2') AS text FROM supplier""")
def src11(t):
    c = F.col("s_name")
    raw = F.concat(F.lit("UNA:+.? 'UNB+X'\nNAD+SH+9++"), c, F.lit(" ?+ CO+PORT ROAD'LOC+9+ABCDE:PORT "), F.col("s_nationkey").cast("string"), F.lit("'MEA+WT+G+TNE:"), F.col("s_suppkey").cast("string"),
                   F.lit("'EQD+CN+1'EQD+CN+2'DTM+133:20260320:102'FTX+AAA+++Consignee?: "), c, F.lit("'"))
    return t("supplier").select(F.col("s_suppkey").alias("doc"), S.edifact_lines(raw).alias("text"))


@query("src12_x12", """SELECT s_suppkey AS doc, concat_ws(chr(10), 'Shipper | ' || s_name, '12 ROAD', 'TOWN, MY', 'Gross Weight (KG) | ' || format('{:,.2f}', s_suppkey * 1.0) || ' KG', 'Port of Discharge | PORT (ABCDE)', 'ETA | 2026-03-20', 'Container Count | 1') AS text FROM supplier""")
def src12(t):
    raw = F.concat(F.lit("ST*404*0001~N1*SH*"), F.col("s_name"), F.lit("~N3*12 ROAD~N4*TOWN*MY~N7*ABCU~MEA*WT*G*"), F.col("s_suppkey").cast("string"), F.lit("*KG~R4*2*K*ABCDE*PORT~DTM*178*20260320~"))
    return t("supplier").select(F.col("s_suppkey").alias("doc"), S.x12_lines(raw).alias("text"))


@query("src13_edi_syntax", """SELECT p_partkey AS doc, CASE p_partkey % 5 WHEN 0 THEN 'x12' WHEN 1 THEN 'edifact' WHEN 2 THEN 'x12' WHEN 3 THEN 'edifact' END AS syntax FROM part""")
def src13(t):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, "ISA*00*").when(k == 1, "UNB+UNOA").when(k == 3, "NAD+SH\nLOC+9\nMEA+WT").otherwise(F.col("p_name"))
    name = F.when(k == 2, "a.X12").otherwise("b.txt")
    return t("part").select(F.col("p_partkey").alias("doc"), S.edi_syntax(name, text).alias("syntax"))


_strip = r"regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"


@query("src14_html_text", f"SELECT page_id, {D.squeeze(_strip)} AS text FROM pages")
def src14(t):
    return t("pages").select("page_id", M.html_to_text(F.col("html")).alias("text"))


@query("src15_nested_documents", "SELECT email_id, 'fw_' || email_id || '.frombody.txt' AS path, trim('From: ' || sender || chr(10) || 'Subject: ' || subject || chr(10) || repeat(body || chr(10), 40), ' ' || chr(10)) AS text FROM fx_all_mails")
def src15(t):
    return M.nested_documents(all_mails(t).withColumn("body", F.repeat(F.concat("body", F.lit("\n")), 40)).withColumn("filename", F.concat(F.lit("in/fw_"), F.col("email_id"), F.lit(".EML"))))


step("ox_fwd", "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations")


@query("src16_unbundled", "SELECT CAST(conv_id AS VARCHAR) AS email_id, idx, total, '---------- Forwarded message (Batch ' || idx || ' of ' || total || ') ---------' || chr(10) || 'From: ' || role || chr(10) || 'Forwarded-By: hub' || chr(10) || chr(10) || text AS body FROM ox_fwd WHERE total > 1")
def src16(t):
    c = t("conversations")
    # The turns of one conversation stand for the messages nested in one mail.
    n = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("sender"), F.lit("").alias("subject"), F.lit("").alias("date"), F.col("text").alias("body")))).alias("nested"))
    m = n.select(F.col("conv_id").cast("string").alias("email_id"), F.lit("hub").alias("sender"), "nested", F.lit(True).alias("direct_documents"))
    return M.unbundle(m).select("email_id", F.col("idx").cast("bigint").alias("idx"), F.col("total").cast("bigint").alias("total"), "body")


_contract = "CASE WHEN status = 'ERROR' THEN 'NEEDS_REVIEW' WHEN status IN ('OK','MISMATCH','NEEDS_REVIEW') THEN status WHEN category = 'BL_COMPARISON' THEN 'NEEDS_REVIEW' ELSE 'OK' END"


@query("snk1_submission", f"SELECT m.email_id, coalesce(category, 'GENERAL') AS category, {_contract} AS status, review_reason, coalesce(has_defect, false) AS has_defect, coalesce(defect_field, '') AS defect_fields FROM fx_all_mails m LEFT JOIN fx_reports r ON r.email_id = m.email_id")
def snk1(t):
    r = t.view("fx_reports").withColumn("defect_fields", F.array_compact(F.array("defect_field")))
    return M.submission(t.view("fx_all_mails"), r).withColumn("defect_fields", F.array_join("defect_fields", ","))


@query("snk2_contract_status", f"SELECT email_id, {_contract} AS status FROM fx_reports")
def snk2(t):
    return t.view("fx_reports").select("email_id", M.contract_status(F.col("status"), F.col("category")).alias("status"))


# ------------------------------------------------------------ remaining scalars
@query("nrm8_naive_utc", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE date_trunc('second', ts) - CASE event_id % 5 WHEN 1 THEN INTERVAL 2 HOURS WHEN 2 THEN INTERVAL (-330) MINUTES ELSE INTERVAL 0 HOURS END END AS at FROM events")
def nrm8(t):
    k = F.col("event_id") % 5
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    s = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+02:00"))).when(k == 2, F.concat(iso, F.lit("-05:30"))).when(k == 3, iso).otherwise("soon")
    return t("events").select("event_id", T.naive_utc(s).alias("at"))


@query("nrm9_received_time", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '1970-01-01' + INTERVAL (event_id) SECOND ELSE date_trunc('second', ts) - CASE WHEN event_id % 3 = 1 THEN INTERVAL 8 HOURS ELSE INTERVAL 0 HOURS END END AS at FROM events")
def nrm9(t):
    k = F.col("event_id") % 3
    h = F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss")
    s = F.when(k == 1, F.concat(h, F.lit(" +0800 (MYT)"))).when(k == 2, F.concat(h, F.lit(" GMT"))).otherwise("yesterday")
    return t("events").select("event_id", T.received_time(s, F.col("event_id") * 1000).alias("at"))


@query("nrm10_edi_dates", "SELECT o_orderkey AS id, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y%m%d') END AS d FROM orders")
def nrm10(t):
    k = F.col("o_orderkey") % 3
    v = F.when(k == 1, F.date_format("o_orderdate", "yyMMdd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return t("orders").select(F.col("o_orderkey").alias("id"), T.edi_date(v, F.when(k == 0, "102").when(k == 1, "101").otherwise("999")).alias("d"))


@query("nrm11_units", "SELECT p_partkey AS id, round(p_size * CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1000.0::DOUBLE WHEN 2 THEN 0.45359237::DOUBLE WHEN 3 THEN 907.18474::DOUBLE END, 6) AS kg FROM part")
def nrm11(t):
    k = F.col("p_partkey") % 5
    u = F.when(k == 0, "kg").when(k == 1, "TNE").when(k == 2, " lbs").when(k == 3, "STN").otherwise("MTQ")
    return t("part").select(F.col("p_partkey").alias("id"), F.round(F.col("p_size") * T.unit_factor(u), 6).alias("kg"))


@query("nrm12_places", "SELECT s_suppkey AS id, CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN s_name || ' (MYPKG)' WHEN 1 THEN s_name || ' (MYPKG)' ELSE 'MYPKG' END AS place FROM supplier")
def nrm12(t):
    k = F.col("s_suppkey") % 3
    parts = F.when(k == 0, F.array(F.col("s_name"), F.lit("mypkg"))).when(k == 1, F.array(F.lit("12"), F.lit("MYPKG"), F.col("s_name"))).otherwise(F.array(F.lit("MYPKG"), F.lit("")))
    return t("supplier").select(F.col("s_suppkey").alias("id"), T.place(parts).alias("place"))


@query("nrm13_ocr_digits", "SELECT id, CASE WHEN regexp_matches(raw, '[0-9]') THEN translate(raw, 'OoIl', '0011') ELSE raw END AS v FROM fx_measures")
def nrm13(t):
    return t.view("fx_measures").select("id", T.ocr_digits(F.col("raw")).alias("v"))


# Every third document gets a tail of wide blanks, which begins behind its first half.
@query("ext2_unreadable", r"SELECT doc_id, length(t) > 0 AND (length(t) - length(regexp_replace(t, '[^ \n\r\t\P{C}]|[^ \P{Z}]', '', 'g'))) > length(t) * 0.15 AS unreadable FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || repeat(chr(8195), length(text)) ELSE text END AS t FROM documents) x")
def ext2(t):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.repeat(F.lit("\u2003"), F.length("text")))).otherwise(F.col("text"))
    return t("documents").select("doc_id", T.unreadable(text).alias("unreadable"))


@query("ext6_next_line_values", "SELECT email_id, doc_type, ln, src FROM ox_source WHERE src IS NOT NULL")
def ext6(t):
    # The outer form: a plain inline would work the array out a second time to see whether it is empty.
    rows = t.docs.select("email_id", "doc_type", F.inline_outer(X.sources_of(X.lines_of(F.col("text")))))
    return rows.filter("src IS NOT NULL").select("email_id", "doc_type", "ln", "src")


@query("ext9_placeholders", f"SELECT email_id, doc_type, ln, {D.has(D.squeeze('src'), rules.PLACEHOLDER)} AS placeholder FROM ox_source WHERE val IS NOT NULL".replace("WHERE val IS NOT NULL", "WHERE src IS NOT NULL"))
def ext9(t):
    return ext6(t).select("email_id", "doc_type", "ln", T.is_placeholder(F.col("src")).alias("placeholder"))


@query("ext11_backfill", "SELECT s.email_id, " + ", ".join(f"coalesce(b.{f}, s.{f}) AS {f}" for f in rules.ALL_FIELDS) + " FROM ox_fields s JOIN ox_fields b ON b.email_id = s.email_id AND b.doc_type = 'BL' WHERE s.doc_type = 'SI'")
def ext11(t):
    p = pairs(t)
    return p.select("email_id", X.backfill(F.col("bl"), F.col("si")).alias("m")).select("email_id", "m.*")


@query("ext10_best_reading", "SELECT email_id, CAST(max(c) AS INT) AS field_count FROM (SELECT d.email_id, " + " + ".join(f"CAST({f} IS NOT NULL AS INT)" for f in rules.COMPARED_FIELDS) + " AS c FROM ox_fields f JOIN fx_docs d ON d.path = f.path WHERE d.text <> '' AND NOT (d.doc_type = 'SI' AND d.k % 3 = 0)) x GROUP BY email_id")
def ext10(t):
    # Two readings per mail: the instruction's text, which every third mail lacks, and the draft's, with fewer fields in some.
    c = t.docs.select("email_id", F.when(F.col("doc_type") == "SI", 0).otherwise(1).alias("rung"), F.when((F.col("doc_type") == "SI") & (F.col("k") % 3 == 0), "").otherwise(F.col("text")).alias("text"))
    return X.best_reading(c, ["email_id"]).select("email_id", F.col("yield").alias("field_count"))


@query("ext12_labels_from_keys", "SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[_.-]+', ' ', 'g'), '[^A-Za-z0-9 ()/%&]', ' ', 'g'), ' +', ' ', 'g')) AS label FROM fx_files")
def ext12(t):
    return t.view("fx_files").select("id", T.label_from_key(F.col("name")).alias("label"))


@query("ext13_invoice_fields", "SELECT o_orderkey AS id, 'INV-' || o_orderkey AS invoice_number, printf('%.2f', o_totalprice) AS total_amount, 'USD' AS currency FROM orders")
def ext13(t):
    text = F.concat(F.lit("Invoice No: INV-"), F.col("o_orderkey").cast("string"), F.lit("\nGrand Total USD "), F.format_number("o_totalprice", 2))
    return t("orders").select(F.col("o_orderkey").alias("id"), X.invoice_fields(text).alias("f")).select("id", "f.*")


@query("ext14_clean_text", f"SELECT doc_id, {D.strip(D.sub(D.sub('text', '[ ' + chr(92) + 't]{2,}', '  '), chr(92) + 'n{3,}', chr(10) + chr(10)))} AS text FROM documents")
def ext14(t):
    return t("documents").select("doc_id", T.clean_extracted(F.col("text")).alias("text"))


for _n, _w in {"cmp2_undecidable": "match = 'UNDECIDABLE'", "cmp3_numbers": "field = 'gross_weight_kg'", "cmp4_names": "field IN ('shipper', 'consignee', 'notify_party')",
               "cmp5_ports": "field IN ('port_of_loading', 'port_of_discharge')", "cmp6_informational": "field IN ('etd', 'eta')"}.items():
    query(_n, f"SELECT email_id, field, match FROM ox_pair_long WHERE {_w}")(lambda t, w=_w: long_results(pairs(t)).filter(w).select("email_id", "field", "match"))


@query("cmp16_flattened_results", "SELECT email_id, field, si_value AS si, bl_value AS bl FROM ox_pair_long")
def cmp16(t):
    m = F.map_from_entries(F.transform("field_results", lambda r: F.struct(r["field"], F.struct(r["si_value"].alias("si"), r["bl_value"].alias("bl")))))
    return pairs(t).select("email_id", F.explode(m).alias("field", "v")).select("email_id", "field", "v.si", "v.bl")


@query("cmp17_fulfilment", "SELECT m.email_id, k.doc_type, d.path IS NOT NULL AS found FROM fx_emails m CROSS JOIN (VALUES ('SI'), ('BL')) k(doc_type) LEFT JOIN fx_docs d ON d.email_id = m.email_id AND d.doc_type = k.doc_type")
def cmp17(t):
    want = t.mails.select("email_id", F.explode(F.array(F.lit("SI"), F.lit("BL"))).alias("doc_type"))
    return want.join(t.docs.select("email_id", "doc_type", "path"), ["email_id", "doc_type"], "left").select("email_id", "doc_type", F.col("path").isNotNull().alias("found"))


def token_differences(results):
    """CMP11: bag difference of the words of two values, by occurrence number.

    A value is short, so occurrence numbers come from its own token array.
    """
    def bag(c):
        words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z0-9]+(?:[.'/-][A-Za-z0-9]+)*|[^\sA-Za-z0-9]+"), F.lit(0))
        return T.let(words, lambda w: F.transform(w, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(w, 1, i + 1), lambda y: y == x)).cast("string"))))
    df = results.withColumn("s", bag(F.col("si_value"))).withColumn("b", bag(F.col("bl_value")))
    return df.select("email_id", "field", F.array_join(F.array_intersect("s", "b"), " ").alias("same"), F.array_join(F.array_except("s", "b"), " ").alias("deleted"),
                     F.array_join(F.array_except("b", "s"), " ").alias("inserted"))


@query("cmp11_token_difference", """SELECT report_id, CASE WHEN field_name = 'consignee' THEN 5 ELSE 1 END AS deleted, CASE WHEN field_name = 'consignee' THEN 3 ELSE 1 END AS inserted FROM fx_issues""")
def cmp11(t):
    i = t.view("fx_issues").select(F.col("report_id").alias("email_id"), F.col("field_name").alias("field"), "si_value", "bl_value")
    n = lambda c: F.size(F.filter(F.split(c, " "), lambda x: x != ""))
    return token_differences(i).select(F.col("email_id").alias("report_id"), n("deleted").alias("deleted"), n("inserted").alias("inserted"))


# Two wordings of one description: words move, repeat and differ.
WORDINGS = "SELECT p_partkey AS id, p_name || ', ' || p_type || ' x' || CAST(p_size AS STRING) AS si_value, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_type || ' (' || p_name || ') x' || CAST(p_size % 7 AS STRING) END AS bl_value FROM part"
step("ox_wordings", WORDINGS)
step("ox_words", f"""SELECT id, regexp_extract_all(si_value, {chr(39)}[A-Za-z0-9]+(?:[.{chr(39) * 2}’/-][A-Za-z0-9]+)*|\\s+|[^\\sA-Za-z0-9]+{chr(39)}) AS a, regexp_extract_all(bl_value, {chr(39)}[A-Za-z0-9]+(?:[.{chr(39) * 2}’/-][A-Za-z0-9]+)*|\\s+|[^\\sA-Za-z0-9]+{chr(39)}) AS b FROM ox_wordings""".replace(chr(92) * 2, chr(92)))
# One cell of the table per step, in the order in which it is filled; the walk then reads it.
step("ox_cells", """SELECT id, a, b, len(a) AS n, len(b) AS m, 0 AS k, CAST([] AS INTEGER[]) AS dp FROM ox_words
  UNION ALL SELECT id, a, b, n, m, k + 1, list_append(dp, CASE WHEN a[n - k // m] = b[m - k % m] THEN CASE WHEN k >= m AND k % m > 0 THEN dp[k - m] ELSE 0 END + 1
    ELSE greatest(CASE WHEN k >= m THEN dp[k - m + 1] ELSE 0 END, CASE WHEN k % m > 0 THEN dp[k] ELSE 0 END) END) FROM ox_cells WHERE k < n * m""")
step("ox_walk", """SELECT id, a, b, n, m, 0 AS i, 0 AS j, dp, CAST([] AS VARCHAR[]) AS ops FROM ox_cells WHERE k = n * m AND n * m > 0
  UNION ALL SELECT id, a, b, n, m, i + (op <> '+')::INTEGER, j + (op <> '-')::INTEGER, dp, list_append(ops, op || CASE WHEN op = '+' THEN b[j + 1] ELSE a[i + 1] END) FROM (
    SELECT *, CASE WHEN i < n AND j < m AND a[i + 1] = b[j + 1] THEN '=' WHEN j >= m THEN '-' WHEN i >= n THEN '+'
      WHEN CASE WHEN i + 1 < n THEN dp[(n - 2 - i) * m + m - j] ELSE 0 END >= CASE WHEN j + 1 < m THEN dp[(n - 1 - i) * m + m - j - 1] ELSE 0 END THEN '-' ELSE '+' END AS op FROM ox_walk WHERE i < n OR j < m) x""")


@query("cmp11_aligned_difference", "SELECT w.id, array_to_string(o.ops, '~') AS ops FROM ox_words w LEFT JOIN (SELECT id, ops FROM ox_walk WHERE i = n AND j = m) o ON o.id = w.id")
def cmp11_aligned(t):
    mark = lambda x: F.concat(F.when(x["op"] == "same", "=").when(x["op"] == "del", "-").otherwise("+"), x["token"])
    ops = K.aligned_difference(K.tokens(F.col("si_value")), K.tokens(F.col("bl_value")))
    return t.sql(WORDINGS).select("id", F.array_join(F.transform(ops, mark), "~").alias("ops"))
