"""Scalar functions, field extraction and pair comparison."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..operators import compare as K, extract as X
from . import duck as D
from .registry import query, step

FIELDS = rules.ALL_FIELDS
LINES = r"\r\n|[\n\r\x{b}\x{c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"

# --------------------------------------------------------------- oracle steps
step("ox_line", f"""
SELECT email_id, doc_type, path, ln, regexp_replace(line, '[ \\t]{{2,}}', '  ', 'g') AS line FROM (
  SELECT email_id, doc_type, path, unnest(string_split_regex(text, {D.q(LINES)})) AS line,
         generate_subscripts(string_split_regex(text, {D.q(LINES)}), 1) AS ln FROM fx_docs) x
""")


def _label_sql(m: str) -> str:
    pos = [f"CASE WHEN {D.has(m, '(?i)' + X.ALTERNATION[f])} THEN length({D.ext(m, '(?is)^(.*?)(?:' + X.ALTERNATION[f] + ')')}) END"
           for f in FIELDS]
    least = "least(" + ", ".join(pos) + ")"
    return "CASE " + " ".join(f"WHEN {p} = {least} THEN {i}" for i, p in enumerate(pos)) + " END"


step("ox_label", f"""
SELECT *, {_label_sql('m')} AS ord FROM (SELECT *, {D.squeeze('line')} AS m FROM ox_line) x
""")
_cell = r"(?s)^(.*?)(?:\s*\||\t+)(.*)$"
step("ox_value", f"""
SELECT l.email_id, l.doc_type, l.path, l.ln, l.ord,
  CASE WHEN {D.has('l.line', '[|]|' + chr(92) + 't')} AND {D.strip(D.ext('l.line', _cell, 1))} <> '' AND {D.strip(D.ext('l.line', _cell, 2))} <> ''
         THEN {D.strip(D.ext('l.line', _cell, 2))}
       WHEN {D.has('l.line', '^[^:：]*[:：]')} THEN nullif({D.strip(D.ext('l.line', '(?s)^[^:：]*?[:：](.*)$'))}, '')
       ELSE nullif({D.strip(D.ext('l.line', '(?s)^[^:：]*?[-–]' + chr(92) + 's+(.*)$'))}, '') END AS val,
  (SELECT arg_min({D.strip('n.line')}, n.ln) FROM ox_label n WHERE n.path = l.path AND n.ln > l.ln AND {D.strip('n.line')} <> '') AS nxt
FROM ox_label l WHERE l.ord IS NOT NULL
""")
step("ox_source", f"""
SELECT email_id, doc_type, path, ln, ord, coalesce(val, CASE WHEN ord < 5 AND NOT ({D.has('nxt', '^[^:|]*[:|]')} AND {_label_sql('nxt')} IS NOT NULL) THEN nxt END) AS src
FROM ox_value
""")
step("ox_found", f"""
SELECT email_id, doc_type, path, ln, ord, CASE
  WHEN ord < 3 THEN {D.value_or_null('nm')} WHEN ord < 5 THEN {D.value_or_null('po')}
  WHEN ord = 5 THEN CAST(cc AS VARCHAR) WHEN ord = 6 THEN CAST(wt AS VARCHAR) ELSE dt END AS v
FROM (SELECT *, {D.clean_name('src')} AS nm, {D.clean_port('src')} AS po, {D.container_count('src')} AS cc,
      {D.weight_kg('src')} AS wt, {D.iso_date('src')} AS dt FROM ox_source) x
""")
step("ox_fields", "SELECT d.email_id, d.doc_type, d.path, " + ", ".join(
    (f"CAST(arg_min(f.v, f.ln) FILTER (WHERE f.ord = {i} AND f.v IS NOT NULL) AS "
     f"{ {'container_count': 'BIGINT', 'gross_weight_kg': 'DOUBLE'}.get(n, 'VARCHAR')}) AS {n}") for i, n in enumerate(FIELDS))
    + " FROM fx_docs d LEFT JOIN ox_found f ON f.path = d.path GROUP BY ALL")
step("ox_norm", "SELECT email_id, doc_type, "
     + ", ".join(f"{D.norm_name(f)} AS {f}" for f in rules.NAME_FIELDS) + ", "
     + ", ".join(f"{D.norm_port(f)} AS {f}, {D.port_name(f)} AS {f}_name, {D.port_code(f)} AS {f}_code" for f in rules.PORT_FIELDS)
     + ", container_count, gross_weight_kg, etd, eta FROM ox_fields")


def _match_sql(f):
    a, b = f"s.{f}", f"b.{f}"
    fuzzy = f"WHEN levenshtein({a}, {b}) <= 2 THEN 'POSSIBLE' "
    if f == "gross_weight_kg":
        body = f"WHEN abs({a} - {b}) < 0.001 THEN 'MATCH' "
    elif f in rules.PORT_FIELDS:
        body = (f"WHEN {a} = {b} OR ((s.{f}_code IS NULL) <> (b.{f}_code IS NULL) AND s.{f}_name = b.{f}_name) THEN 'MATCH' " + fuzzy)
    else:
        body = f"WHEN {a} = {b} THEN 'MATCH' " + (fuzzy if f in rules.NAME_FIELDS else "")
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'UNDECIDABLE' {body}ELSE 'DIFF' END"


step("ox_match", "SELECT s.email_id, " + ", ".join(f"{_match_sql(f)} AS m_{f}" for f in FIELDS)
     + " FROM ox_norm s JOIN ox_norm b ON s.email_id = b.email_id AND s.doc_type = 'SI' AND b.doc_type = 'BL'")


def _shown_sql(a, f):
    if f == "gross_weight_kg":
        return f"CASE WHEN {a}.{f} = floor({a}.{f}) THEN CAST(CAST({a}.{f} AS BIGINT) AS VARCHAR) ELSE CAST({a}.{f} AS VARCHAR) END"
    return f"CAST({a}.{f} AS VARCHAR)"


step("ox_pair_long", " UNION ALL ".join(
    f"SELECT m.email_id, '{f}' AS field, {i} AS ord, {_shown_sql('s', f)} AS si_value, {_shown_sql('b', f)} AS bl_value, m.m_{f} AS match "
    f"FROM ox_match m JOIN ox_fields s ON s.email_id = m.email_id AND s.doc_type = 'SI' "
    f"JOIN ox_fields b ON b.email_id = m.email_id AND b.doc_type = 'BL'"
    + ("" if f in rules.COMPARED_FIELDS else f" WHERE s.{f} IS NOT NULL OR b.{f} IS NOT NULL")
    for i, f in enumerate(FIELDS)))
step("ox_roll", """
SELECT email_id,
  CASE WHEN u > 0 THEN 'NEEDS_REVIEW' WHEN d > 0 THEN 'MISMATCH' WHEN p > 0 THEN 'NEEDS_REVIEW' ELSE 'OK' END AS status,
  CASE WHEN u > 0 THEN 'missing_value' WHEN d = 0 AND p > 0 THEN 'possible_match' END AS review_reason,
  u = 0 AND d > 0 AS has_defect,
  CASE WHEN u > 0 THEN '' ELSE coalesce(df, '') END AS defect_fields, coalesce(pf, '') AS possible_fields, coalesce(uf, '') AS undecidable_fields
FROM (SELECT email_id, count(*) FILTER (WHERE match = 'UNDECIDABLE') AS u, count(*) FILTER (WHERE match = 'DIFF') AS d,
        count(*) FILTER (WHERE match = 'POSSIBLE') AS p,
        string_agg(field, ',' ORDER BY ord) FILTER (WHERE match = 'DIFF') AS df,
        string_agg(field, ',' ORDER BY ord) FILTER (WHERE match = 'POSSIBLE') AS pf,
        string_agg(field, ',' ORDER BY ord) FILTER (WHERE match = 'UNDECIDABLE') AS uf
      FROM ox_pair_long WHERE ord < 7 GROUP BY email_id) x
""")


# -------------------------------------------------------------- scalar queries
@query("nrm1_whitespace", f"SELECT doc_id, {D.squeeze('text')} AS squeezed FROM documents")
def nrm1(t):
    return t("documents").select("doc_id", T.squeeze(F.col("text")).alias("squeezed"))


@query("nrm2_company_name", f"SELECT id, {D.norm_name('raw')} AS name FROM fx_names")
def nrm2(t):
    return t.view("fx_names").select("id", T.norm_name(F.col("raw")).alias("name"))


step("ox_prose", "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents")


@query("nrm3_printed_values", f"SELECT doc_id, ln, {D.clean_name('line')} AS name, {D.clean_port('line')} AS port FROM ox_prose")
def nrm3(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).alias("ln"), T.clean_name(F.col("line")).alias("name"),
                        T.clean_port(F.col("line")).alias("port"))


@query("nrm4_port", f"SELECT id, {D.norm_port('raw')} AS port, {D.port_name('raw')} AS name, {D.port_code('raw')} AS code FROM fx_ports")
def nrm4(t):
    raw = F.col("raw")
    return t.view("fx_ports").select("id", T.norm_port(raw).alias("port"), T.port_name(raw).alias("name"), T.port_code(raw).alias("code"))


@query("nrm5_container_count", f"SELECT id, raw, CAST({D.container_count('raw')} AS BIGINT) AS boxes FROM fx_measures")
def nrm5(t):
    return t.view("fx_measures").select("id", "raw", T.container_count(F.col("raw")).alias("boxes"))


@query("nrm6_weight", f"SELECT id, raw, {D.weight_kg('raw')} AS kg FROM fx_measures")
def nrm6(t):
    return t.view("fx_measures").select("id", "raw", T.weight_kg(F.col("raw")).alias("kg"))


@query("nrm7_dates", f"SELECT id, raw, {D.iso_date('raw')} AS iso FROM fx_dates")
def nrm7(t):
    return t.view("fx_dates").select("id", "raw", T.iso_date(F.col("raw")).alias("iso"))


# ----------------------------------------------------------- extraction queries
@query("ext1_document_lines", "SELECT email_id, doc_type, ln, line FROM ox_line")
def ext1(t):
    return t.docs.select("email_id", "doc_type", F.posexplode(X.lines_of(F.col("text"))).alias("i", "line")).select(
        "email_id", "doc_type", (F.col("i") + 1).alias("ln"), "line")


@query("ext4_line_labels", "SELECT email_id, doc_type, ln, ord FROM ox_label WHERE ord IS NOT NULL")
def ext4(t):
    rows = t.docs.select("email_id", "doc_type", F.posexplode(X.lines_of(F.col("text"))).alias("i", "line"))
    m = T.squeeze(F.col("line"))
    return rows.filter(m.rlike(X.ANY_LABEL)).select(
        "email_id", "doc_type", (F.col("i") + 1).alias("ln"), X.label_of(F.col("line")).alias("ord"))


@query("ext5_inline_values", "SELECT email_id, doc_type, ln, val FROM ox_value")
def ext5(t):
    rows = t.docs.select("email_id", "doc_type", F.posexplode(X.lines_of(F.col("text"))).alias("i", "line"))
    return rows.filter(T.squeeze(F.col("line")).rlike(X.ANY_LABEL)).select(
        "email_id", "doc_type", (F.col("i") + 1).alias("ln"), T.blank_to_null(X.inline_value(F.col("line"))).alias("val"))


@query("ext7_document_fields", "SELECT email_id, doc_type, " + ", ".join(FIELDS) + " FROM ox_fields")
def ext7(t):
    return X.with_fields(t.docs).select("email_id", "doc_type", *[F.col("fields")[f].alias(f) for f in FIELDS])


@query("ext8_missing_fields", "SELECT email_id, doc_type, concat_ws(',', " + ", ".join(
    f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in rules.COMPARED_FIELDS) + ") AS missing, CAST("
    + " + ".join(f"CAST({f} IS NOT NULL AS INT)" for f in rules.COMPARED_FIELDS) + " AS INT) AS field_count FROM ox_fields")
def ext8(t):
    f = X.with_fields(t.docs)
    return f.select("email_id", "doc_type", F.array_join(X.missing_fields(F.col("fields")), ",").alias("missing"),
                    X.field_yield(F.col("fields")).alias("field_count"))


# ----------------------------------------------------------- comparison queries
def pairs(t):
    # Both halves of a pair are dealt by the key they meet on, so their fields are not shuffled again.
    docs = t.docs.repartition(2 * t.spark.sparkContext.defaultParallelism, "email_id")
    read = K.read_documents(docs)
    return K.compare_pairs(read.filter("doc_type = 'SI'"), read.filter("doc_type = 'BL'"), ["email_id"])


def long_results(p):
    # Every pair has results; the outer form does not work them out a second time to see whether it has.
    return p.select("email_id", F.inline_outer("field_results"))


@query("cmp1_field_results", "SELECT email_id, field, si_value, bl_value, match FROM ox_pair_long")
def cmp1(t):
    return long_results(pairs(t))


@query("cmp7_verdict_rollup", "SELECT * FROM ox_roll")
def cmp7(t):
    return pairs(t).select("email_id", "status", "review_reason", "has_defect",
                           *[F.array_join(c, ",").alias(c) for c in ("defect_fields", "possible_fields", "undecidable_fields")])


@query("cmp_field_mismatch_report", """
SELECT field, count(*) FILTER (WHERE match = 'DIFF') AS differs, count(*) FILTER (WHERE match = 'POSSIBLE') AS possible,
  count(*) FILTER (WHERE match = 'UNDECIDABLE') AS undecidable, count(*) FILTER (WHERE match = 'MATCH') AS matches
FROM ox_pair_long GROUP BY field""")
def mismatch_report(t):
    n = lambda v: F.count_if(F.col("match") == v)
    return long_results(pairs(t)).groupBy("field").agg(
        n("DIFF").alias("differs"), n("POSSIBLE").alias("possible"), n("UNDECIDABLE").alias("undecidable"), n("MATCH").alias("matches"))
