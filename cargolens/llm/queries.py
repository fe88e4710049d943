"""Registered queries of this subpackage, each next to its oracle SQL where DuckDB can express it."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe
from .chat import format_chats, read_back
from .common import table
from .jaccard import jaccard_join
from .lexical import search
from .licences import licence_scan
from .mixing import mix
from .packing import pack
from .pagetext import page_texts
from .quality import RULES, STOP_WORDS, quality_rules
from .resampling import resample
from .secrets import ALLOWED, CLASSES, digest, secret_scan
from .topk import top_k
from .wordpiece import token_counts

QUERIES = {}
ORACLES: dict[str, str] = {}
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_RULES = " AND ".join(f"{r.metric} {op} {bound}" for r in RULES for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None)

QUALITY_STEPS = f"""
q_w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM {{documents}}),
q_win AS (SELECT rid, i, array_to_string(w[i:i + 7], chr(32)) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM q_w WHERE len(w) >= 8)),
q_hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM q_win) WHERE c > 1),
q_rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words FROM (
    SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM q_hit) GROUP BY rid),
q_lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM q_w),
q_counts AS (
    SELECT q_w.rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop
    FROM q_w JOIN q_lines USING (rid) LEFT JOIN q_rep USING (rid)),
q_ratios AS (
    SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
        CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
        CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio
    FROM q_counts),
q_rated AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q_ratios)
"""


@query("op1_quality_rules", f"""
WITH {QUALITY_STEPS.format(documents='documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop, mean_word_chars, symbol_ratio, stop_ratio,
    dup_line_ratio, repeat_ratio, base_failed, NOT base_failed AND {_RULES} AS kept FROM q_rated""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


# Java and RE2 agree on these patterns: nothing in them can match in two ways.
_SPAN_SQL = r"""
s_doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {documents}),
s_hits AS (
    SELECT rid, kind, pos, list_transform(range(1, len(hits) + 1), lambda i: {{'gap': length(gaps[i]), 'len': length(hits[i]), 'value': length(vals[i])}}) AS m
    FROM (
        SELECT rid, 'assign' AS kind, 0 AS pos, regexp_split_to_array(text, P0) AS gaps, regexp_extract_all(text, P0) AS hits, regexp_extract_all(text, P0, 1) AS vals FROM s_doc
        UNION ALL SELECT rid, 'access', 1, regexp_split_to_array(text, P1), regexp_extract_all(text, P1), regexp_extract_all(text, P1) FROM s_doc
        UNION ALL SELECT rid, 'hex', 2, regexp_split_to_array(text, P2), regexp_extract_all(text, P2), regexp_extract_all(text, P2) FROM s_doc WHERE regexp_matches(text, '[0-9a-f]{{24}}'))),
s_flat AS (SELECT rid, kind, pos, i, m[i].gap AS gap, m[i].len AS len, m[i].value AS value FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM s_hits)),
s_at AS (SELECT *, sum(gap + len) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM s_flat),
s_kept AS (SELECT rid, kind, pos, e - len AS s, e FROM s_at WHERE (kind = 'assign' AND value >= 6) OR (kind = 'access' AND len >= 20) OR (kind = 'hex' AND len >= 24)),
s_all AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, pos) AS base FROM s_kept GROUP BY rid)
""".replace("P0", r"""'(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'""").replace("P1", "'AKIA[A-Z0-9]+'").replace("P2", "'[0-9a-f]+'")


# The allow-list without possessive quantifiers, which RE2 lacks and does not need.
_ALLOWED = " OR ".join(f"regexp_matches(run, '{p.replace('*+', '*').replace('++', '+')}')" for p in ALLOWED)
_ENTROPY_SQL = """
e_runs AS ({runs}),
e_flat AS (SELECT rid, kind, pos, bits, win, hits[i] AS run, length(gaps[i]) AS gap, i FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM e_runs)),
e_at AS (SELECT *, sum(gap + length(run)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM e_flat),
e_mixed AS (SELECT *, e - length(run) AS s FROM e_at WHERE regexp_matches(run, '[0-9]') AND regexp_matches(run, '[A-Za-z]') AND NOT ({allowed})),
e_windows AS (SELECT *, substr(run, unnest(range(1, length(run) - win + 2)), win) AS w FROM e_mixed),
e_high AS (SELECT rid, kind, pos, s, e FROM (SELECT rid, kind, pos, s, e, bits, win, list_sum(list_transform(list_distinct(string_split(w, '')),
    lambda c: (length(w) - length(replace(w, c, ''))) * log2(length(w) - length(replace(w, c, ''))))) AS n FROM e_windows) x
    GROUP BY rid, kind, pos, s, e, bits, win HAVING max(log2(win) - n / win) >= bits),
e_cut AS (SELECT h.rid, h.kind, h.pos, h.s AS rs, h.e AS re, b.s AS s, b.e AS e FROM e_high h JOIN s_kept b ON b.rid = h.rid AND b.s < h.e AND h.s < b.e WHERE h.pos = 3
    UNION ALL SELECT rid, kind, pos, s, e, e, e FROM e_high WHERE pos = 3),
e_first AS (SELECT rid, kind, pos, lo AS s, s AS e FROM (SELECT *, greatest(rs, coalesce(max(e) OVER (PARTITION BY rid, rs ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rs)) AS lo FROM e_cut) x WHERE s > lo),
e_known AS (SELECT rid, s, e FROM s_kept UNION ALL SELECT rid, s, e FROM e_first),
e_again AS (SELECT h.rid, h.kind, h.pos, h.s AS rs, h.e AS re, b.s AS s, b.e AS e FROM e_high h JOIN e_known b ON b.rid = h.rid AND b.s < h.e AND h.s < b.e WHERE h.pos = 4
    UNION ALL SELECT rid, kind, pos, s, e, e, e FROM e_high WHERE pos = 4),
e_second AS (SELECT rid, kind, pos, lo AS s, s AS e FROM (SELECT *, greatest(rs, coalesce(max(e) OVER (PARTITION BY rid, rs ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rs)) AS lo FROM e_again) x WHERE s > lo),
e_all AS (SELECT rid, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, pos) AS spans FROM (
    SELECT rid, kind, pos, s, e FROM s_kept UNION ALL SELECT * FROM e_first UNION ALL SELECT * FROM e_second) x GROUP BY rid)
"""


def span_sql(documents: str = "documents") -> str:
    """op6 in SQL: windows are spelled out and counted afresh."""
    runs = []
    for at, c in enumerate(CLASSES):
        pattern = "[" + c.alphabet.replace("-", chr(92) + "-") + f"]{{{c.window},}}"
        runs.append(f"SELECT rid, '{c.name}' AS kind, {3 + at} AS pos, {c.bits} AS bits, {c.window} AS win, regexp_split_to_array(text, '{pattern}') AS gaps, "
                    f"regexp_extract_all(text, '{pattern}') AS hits FROM s_doc WHERE regexp_matches(text, '{pattern}')")
    return f"""WITH {_SPAN_SQL.format(documents=documents)}, {_ENTROPY_SQL.format(runs=' UNION ALL '.join(runs), allowed=_ALLOWED)}
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans FROM s_doc LEFT JOIN s_all USING (rid) LEFT JOIN e_all USING (rid)"""


@query("op6_secret_scan", span_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secret_scan(table(spark, sf_dir, "documents")))


MIX_STEPS = f"""
x_size AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM {{documents}}),
x_src AS (SELECT source, sum(size)::BIGINT AS source_size FROM x_size GROUP BY source),
x_rank AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS rk,
    2 * source_size AS cap, sum(source_size) OVER () * 3 / 2 AS total FROM x_src),
x_full AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
    >= cap * sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM x_rank),
x_aim AS (SELECT source, source_size, CASE WHEN filled THEN cap::DOUBLE
    ELSE (total - coalesce(sum(cap) FILTER (filled) OVER (), 0)) * w / sum(w) FILTER (NOT filled) OVER () END AS target FROM x_full),
x_run AS (SELECT x_size.*, source_size, target, floor(target + 0.5)::BIGINT AS budget,
    sum(size) OVER (PARTITION BY x_size.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
    FROM x_size JOIN x_aim ON x_size.source IS NOT DISTINCT FROM x_aim.source),
x_mix AS (SELECT doc_id, source, size, source_size, target::DOUBLE AS target,
    ((CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * size
     + greatest(0, least(size, budget - (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * source_size - start)))::BIGINT AS taken FROM x_run)
"""


@query("op8_source_mix", f"WITH {MIX_STEPS.format(documents='documents')} SELECT * FROM x_mix")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@query("op2_top_k", """
WITH v_all AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v_pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v_all q JOIN v_all c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
v_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM v_pairs)
SELECT query_id, rank, vec_id, score FROM v_rank WHERE rank <= 20""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


BYTE_RANKS, WORD_BPE = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"
CONTROL_STRINGS = "</s>[INST] ok [/INST]"


@query("op3_chat_format", r"""
WITH c_all AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c_len AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role || chr(10) || text)) AS i,
    length(regexp_replace(regexp_replace(role || text, '(\\)', '\1\1', 'g'), '(<s>|</s>|\[INST\]|\[/INST\])', '\1+', 'g')) AS n FROM c_all)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (3 + sum(n + 6 + 7 + 4))::BIGINT AS formatted_chars
FROM c_len GROUP BY conv_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit(CONTROL_STRINGS).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    path = public_tokenizers.path(BYTE_RANKS)
    return read_back(format_chats(turns, path), path, clustered=True)


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS))


@query("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), digests=True)


@query("op4_jaccard_join", f"""
WITH RECURSIVE j_w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
j_gram AS (SELECT DISTINCT rid, g FROM (
    SELECT rid, array_to_string(w[i:i + 4], chr(32)) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM j_w WHERE len(w) >= 5) a
    UNION ALL SELECT rid, array_to_string(w, chr(32)) FROM j_w WHERE len(w) BETWEEN 1 AND 4) b),
j_size AS (SELECT rid, count(*) AS c FROM j_gram GROUP BY rid),
j_both AS (SELECT x.rid AS a, y.rid AS b, count(*) AS s FROM j_gram x JOIN j_gram y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL),
j_link AS (SELECT a, b, s = x.c AND s = y.c AS same FROM j_both JOIN j_size x ON x.rid = a JOIN j_size y ON y.rid = b WHERE 5 * s >= 4 * (x.c + y.c - s)),
j_reach(a, b) AS (SELECT a, b FROM j_link UNION SELECT r.a, l.b FROM j_reach r JOIN j_link l ON l.a = r.b)
SELECT d.doc_id, least(d.doc_id, (SELECT min(o.doc_id) FROM j_reach r JOIN j_w o ON o.rid = r.b WHERE r.a = d.rid)) AS class_id,
    least(d.doc_id, (SELECT min(o.doc_id) FROM j_link l JOIN j_w o ON o.rid = l.b WHERE l.a = d.rid AND l.same)) AS copy_id,
    (SELECT count(*) FROM j_link l WHERE l.a = d.rid) AS n_links
FROM j_w d""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


@query("op7_page_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


@query("op10_licence_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op11_lexical_search", rf"""
WITH b_doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b_item AS (SELECT row_number() OVER () AS qid, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
b_all AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM b_doc WHERE len(w) > 0),
b_tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM b_doc) x GROUP BY rid, t),
b_df AS (SELECT t, count(*) AS df FROM b_tf GROUP BY t),
b_weight AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM b_df, b_all),
b_m AS (SELECT rid, doc_id, 100 - 50 + ((50 * len(w) * n) // l) AS m FROM b_doc, b_all WHERE len(w) > 0),
b_score AS (SELECT qid, item_id, rid, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM (SELECT qid, item_id, unnest(w) AS t FROM b_item) q JOIN b_weight USING (t) JOIN b_tf USING (t) JOIN b_m USING (rid) GROUP BY ALL),
b_rank AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM b_score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM b_rank WHERE rank <= 50""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# crc32 is spelled out byte by byte over the distinct words; 3988292384 is its reversed polynomial.
_CRC_STEP = "lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END"


@query("op12_target_resampling", rf"""
WITH r_table AS (SELECT list(list_reduce(list_prepend(b, range(8)), {_CRC_STEP}) ORDER BY b) AS crc FROM (SELECT unnest(range(256)) AS b) x),
r_doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
r_item AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
r_tf AS (SELECT rid, f, count(*) AS c FROM (SELECT rid, unnest(w) AS f FROM r_doc) x GROUP BY rid, f),
r_goal AS (SELECT f, count(*) AS c FROM (SELECT unnest(w) AS f FROM r_item) x GROUP BY f),
r_hex AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM r_tf UNION SELECT f FROM r_goal) x),
r_bucket AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INTEGER, 2))::BIGINT)),
    lambda c, b: xor(c // 256, crc[(xor(c, b) % 256 + 1)::INTEGER])), 4294967295::BIGINT) % 10000 AS bucket FROM r_hex, r_table),
r_s AS (SELECT bucket, sum(c)::BIGINT AS s FROM r_tf JOIN r_bucket USING (f) GROUP BY bucket),
r_t AS (SELECT bucket, sum(c)::BIGINT AS t FROM r_goal JOIN r_bucket USING (f) GROUP BY bucket),
r_sum AS (SELECT coalesce((SELECT sum(s) FROM r_s), 0) AS s_all, coalesce((SELECT sum(t) FROM r_t), 0) AS t_all),
r_gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
    FROM (SELECT DISTINCT bucket FROM r_bucket) b LEFT JOIN r_s USING (bucket) LEFT JOIN r_t USING (bucket), r_sum),
r_weight AS (SELECT rid, floor(sum(c * gain)::DOUBLE / sum(c))::BIGINT AS weight FROM r_tf JOIN r_bucket USING (f) JOIN r_gain USING (bucket) GROUP BY rid),
r_score AS (SELECT rid, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM r_doc LEFT JOIN r_weight USING (rid)),
r_order AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r_score WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r_order) THEN rank END AS rank FROM r_score LEFT JOIN r_order USING (rid)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
