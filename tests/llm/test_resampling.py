"""Importance resampling against a plain computation."""
import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from cargolens.llm import resampling
from helpers import awkward, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    return w, [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, percent=10, least=20, buckets=10_000, seed="2024", longest=1):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(of(f) for _, t, *_ in rows for f in features(t, longest)[1])
    goal = Counter(of(f) for _, t in target for f in features(t, longest)[1])
    n_s, n_t = sum(s.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out = []
    for i, t, *_ in rows:
        w, fs = features(t, longest)
        weight = sum(gain(of(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), len(w)])
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    k = percent * len(order) // 100
    ranks = {id(r): x + 1 for x, r in enumerate(order[:k])}
    return sorted((tuple(r[:4]) + (ranks.get(id(r)),) for r in out), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def tables(spark, rows, target):
    docs = documents(spark, rows).withColumns({c: F.lit("x") for c in ("weight", "score", "key", "n_features", "bucket", "_row", "open")})
    return docs, spark.createDataFrame(target, "item_id long, text string")


TARGET = [(1, "Water light STONE river"), (2, None), (3, "tree cloud house the the the"), (3, "é 語 cloud")]


def test_draw_equals_plain_computation(spark):
    rows = awkward() + [(300 + i, "the river of light and stone " * (1 + i % 7), "s") for i in range(200)]
    docs, target = tables(spark, rows, TARGET)
    assert got(resampling.resample(docs, target)) == brute(rows, TARGET)
    assert got(resampling.resample(docs, target, percent=100, least_words=1, buckets=64, seed="x", longest=3)) == brute(rows, TARGET, 100, 1, 64, "x", 3)


def test_ties_and_repeats(spark):
    """Rows without id all have one score; repeated rows are drawn each for itself."""
    rows = [(None, f"water tree {i % 3} " * 10, "s") for i in range(60)] + [(5, "the cloud is in the light " * 5, "s")] * 40
    docs, target = tables(spark, rows, TARGET)
    mine, want = got(resampling.resample(docs, target, percent=30)), brute(rows, TARGET, percent=30)
    assert sorted(r[4] for r in mine if r[4]) == list(range(1, 31))
    assert Counter(r[:4] for r in mine) == Counter(r[:4] for r in want)
    drawn = lambda rs: sorted(r[3] for r in rs if r[4])
    assert drawn(mine) == drawn(want)


def test_quickselect_with_few_pivots(spark):
    values = [(i * 7919 % 1009, None if i % 5 == 0 else i) for i in range(400)]
    keyed = spark.createDataFrame(values, "a long, b long").select(F.struct("a", "b", F.monotonically_increasing_id().alias("c")).alias("key")).cache()
    order = sorted((tuple(r.key) for r in keyed.collect()), key=resampling._sortable)
    for k in (1, 2, 57, 200, 399, 400):
        assert resampling.quickselect(keyed, k, pivots=2) == order[k - 1]


def test_empty_tables(spark):
    docs, target = tables(spark, [], TARGET)
    assert resampling.resample(docs, target).count() == 0
    docs, nothing = tables(spark, awkward(), [])
    assert got(resampling.resample(docs, nothing)) == brute(awkward(), [])
    docs, target = tables(spark, [(1, None, "a"), (2, "too short", "a")], TARGET)
    assert [r[4] for r in got(resampling.resample(docs, target))] == [None, None]
