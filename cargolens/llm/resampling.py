"""Importance resampling towards a target distribution: array-scored weights and a distributed quickselect."""
from __future__ import annotations

import hashlib
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

BUCKETS = 10_000
SEED = "2024"
PERCENT = 10
LEAST_WORDS = 20
PIVOTS = 15  # random keys of one round
KNOWN_WORDS = 500_000  # whose bucket a worker remembers; beyond it starts anew

# A-Z become lower case, all other ASCII but digits and a-z parts words.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isdigit() or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def text_words(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_FOLD).split()


class Buckets(dict):
    """The bucket of a feature, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        b = self[feature] = crc32(feature) % self.buckets
        return b

    def of(self, words: list[bytes], longest: int) -> np.ndarray:
        """Buckets of all runs of up to so many words, repeats counted."""
        runs = words if longest == 1 else [b" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """``bucket, n``: how often features of all texts fall into each bucket. A partition sends one array of counts."""
    raw = rows.select(F.col(text_col).cast("binary").alias("text"))

    def counted(batches):
        of, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column("text"):
                found = of.of(text_words(t.as_py()), longest)
                if len(found) < 64:
                    np.add.at(total, found, 1)
                else:
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(total[at])})

    return raw.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _array(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets)
    for r in counts.collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the smoothed log ratio of target to source, in thousandths, rounded down."""
    n = len(source)
    ratio = (target + 1) * (source.sum() + n) / ((source + 1) * (target.sum() + n))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def noise(doc_id, seed: str) -> int:
    """A Gumbel variate in thousandths that depends on seed and id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: str, longest: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_features, n_words, weight, score, text_hash`` per document."""
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_hash"))

    def weighed(batches):
        of = Buckets(len(gain))
        for b in batches:
            n_features, n_words, weight, score = [], [], [], []
            for i, t in zip(b.column("doc_id"), b.column("text")):
                words = text_words(t.as_py())
                found = of.of(words, longest)
                w = int(gain[found].sum()) // len(found) if len(found) else 0
                n_features.append(len(found))
                n_words.append(len(words))
                weight.append(w)
                score.append(w + noise(i.as_py(), seed))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_features, n_words, weight, score)), b.column("text_hash")],
                                             names=["doc_id", "n_features", "n_words", "weight", "score", "text_hash"])

    return raw.mapInArrow(weighed, f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, n_features long, n_words long, weight long, score long, text_hash long")


def _literal(key, like: DataFrame) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, like.schema["key"].dataType.fields)])


def quickselect(keyed: DataFrame, k: int, pivots: int = PIVOTS):
    """The k-th smallest value of the struct column ``key``, whose values are unique.

    Each round draws random pivots from the open interval that still holds the k-th key and
    counts exactly how many keys of the interval are below and at each of them; the interval
    shrinks to the gap between two pivots. The keys stay where they are: a round sends
    counts, and with so many pivots the rounds grow with the logarithm of the rows.
    """
    low = high = None
    below, turn = 0, 0
    while True:
        inside = keyed
        if low is not None:
            inside = inside.where(F.col("key") > _literal(low, keyed))
        if high is not None:
            inside = inside.where(F.col("key") < _literal(high, keyed))
        drawn = sorted((tuple(r["key"]) for r in inside.orderBy(F.xxhash64("key", F.lit(turn))).limit(pivots).select("key").collect()), key=_sortable)
        if len(drawn) < pivots:  # these are all
            return drawn[k - below - 1]
        counts = inside.agg(*[F.count_if(F.col("key") < _literal(p, keyed)).alias(f"less{i}") for i, p in enumerate(drawn)],
                            *[F.count_if(F.col("key") == _literal(p, keyed)).alias(f"same{i}") for i, p in enumerate(drawn)]).first()
        inner = below
        for i, p in enumerate(drawn):
            less, same = counts[f"less{i}"], counts[f"same{i}"]
            if inner + less < k <= inner + less + same:
                return p
            if inner + less >= k:
                high = p
                break
            low, below = p, inner + less + same
        turn += 1


def _sortable(key) -> tuple:
    """Orders keys in Python as Spark orders them: null first, strings by their bytes."""
    return tuple((v is not None, (v.encode() if isinstance(v, str) else v) if v is not None else 0) for v in key)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: str = SEED, longest: int = 1,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` per document; rank is null where it is not drawn.

    Features are hashed into buckets; a document's weight is the floored mean gain of its
    features, where a bucket's gain is the log ratio of its shares in the target and in all
    documents. Weight plus Gumbel noise is the score, so the highest scores are a draw
    without replacement in proportion to the importance weights. Drawn are
    ``percent`` hundredths of the documents of enough words.

    1. One pass counts buckets; the arrays, one number per bucket, meet on the driver.
    2. A second pass scores each document by array lookups and writes the small rows.
    3. The composite key (score falling, id, text hash, row) is unique; ``quickselect`` finds
       the last key that is drawn.
    4. Winners alone are range-sorted; a range's rows follow those of the ranges before it.

    A null text has no features, weight 0 and is never drawn while words are asked for. A
    null id has the noise of an empty id and comes behind other ids of its score. Repeated
    rows are drawn each for itself. An empty target gives all buckets their smoothed gain. An
    empty table gives no rows.
    """
    gain = gains(_array(bucket_counts(docs, text_col, buckets, longest), buckets), _array(bucket_counts(target, text_col, buckets, longest), buckets))
    rows = cut(scored(docs, gain, seed, longest, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    key = F.struct((-F.col("score")).alias("score"), F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "_row").alias("key")
    keyed = rows.select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("open"), key)
    n = keyed.where("open").count()
    k = percent * n // 100
    out = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return keyed.select(*out, undrawn)
    last = _literal(quickselect(keyed.where("open").select("key"), k), keyed)
    won = F.col("open") & (F.col("key") <= last)
    ordered = cut(keyed.where(won).orderBy("key").select(*out).withColumn("_at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_range", F.shiftright("_at", 33))
    ranges = ordered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per range of the sort
    before = ranges.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).select("_range", "_before")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ordered.join(before, "_range").select(*out, place.alias("rank"))
    return ranked.unionByName(keyed.where(~won).select(*out, undrawn))
