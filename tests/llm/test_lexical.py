"""Ranked search against scoring every document."""
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cargolens.llm import lexical
from helpers import awkward, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, items, k=50):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t, *_ in rows if terms(t)]
    n, l = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        wanted = [(t, math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t in set(terms(text)) if t in df]
        scored = []
        for i, c, length in docs:
            m = 50 + 50 * length * n // l
            s = sum(w * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t, w in wanted if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, rows, items, **kw):
    docs = documents(spark, rows).withColumns({c: F.lit("x") for c in ("hash", "number", "bound", "item_id", "width", "bits", "terms")})
    df = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)), **kw)
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(n, seed=1, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(4 * words)]
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 30, 80, 400]))), "s") for i in range(n)]


ITEMS = [(1, "w1 w2 w3 W17 w17"), (2, "the of THE and"), (3, None), (4, ""), (5, "no-such-term zzz"), (6, "é 語 w9"), (6, "w5"), (None, "w1"), (8, "river light")]


def test_search_equals_scoring_all(spark):
    rows = awkward() + corpus(300)
    assert found(spark, rows, ITEMS) == brute(rows, ITEMS)


def test_ties_repeats_and_small_blocks(spark, monkeypatch):
    """Many equal scores around the last rank; blocks of a few documents; queries in several passes."""
    for name, value in {"BLOCK_DOCS": 16, "QUERY_BLOCK": 2, "FLUSH_TERMS": 10}.items():
        monkeypatch.setattr(lexical, name, value)
    rows = corpus(80, 2) + [(1000 - i, "tie w1 w2", "s") for i in range(90)] + [(77, "again w3 w3 w3", "s")] * 6 + [(None, "again w3", "s")] * 3
    assert found(spark, rows, ITEMS, k=7) == brute(rows, ITEMS, 7)


def test_bounds_hold_and_exclude(spark):
    rows = corpus(400, 3)
    queries = lexical.Queries([(i, t and lexical.terms(t.encode()) or []) for i, (_, t) in enumerate(ITEMS)])
    docs = documents(spark, rows, clash=False)
    signatures = lexical.index(docs)
    n, l = lexical.totals(signatures)
    assert (n, l) == (sum(bool(terms(t)) for _, t, _ in rows), sum(len(terms(t)) for _, t, _ in rows))
    queries.weigh(lexical._frequencies(signatures, queries.terms), n, l)
    texts, excluded = {i: t for i, t, _ in rows}, 0
    for block in signatures.where("width IS NOT NULL").collect():
        bound = queries.bounds(block.asDict())
        for d, i in enumerate(block.ids):
            w = lexical.terms(texts[i].encode())
            for q in range(len(queries.of)):
                exact = queries.exact(q, len(w), Counter(w))
                assert bound[q, d] >= exact
                excluded += bound[q, d] < 1.1 * exact + 1
    assert excluded > 0.9 * len(rows) * len(queries.of)


def test_long_texts_have_wide_signatures(spark):
    rows = [(1, " ".join(f"t{i}" for i in range(20_000)), "s"), (2, "t5 t6", "s")]
    widths = {w for (w,) in lexical.index(documents(spark, rows)).where("width IS NOT NULL").select("width").collect()}
    assert widths == {64, 1 << 18}
    assert np.all(np.diff(lexical.LEVELS) > 0)


def test_empty_tables(spark):
    assert found(spark, [], ITEMS) == [] and found(spark, corpus(5), []) == [] and found(spark, [(1, None, "a"), (2, " ", "a")], ITEMS) == []
