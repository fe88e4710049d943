"""Ranked lexical search over bit-sliced Bloom signatures, exact by rescoring all that bounds cannot exclude."""
from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut

K = 50
ONE = 1_000_000_000
HASHES = 4  # slices a term sets
BITS = 12  # slices per inserted item, at least
LEVELS = [1, *(b * m // 2 for b in (2 ** i for i in range(1, 30)) for m in (2, 3))]  # occurrence counts that are told apart
BLOCK_DOCS, BLOCK_CELLS = 4096, 1 << 23  # documents and bits of one block of signatures, at most
QUERY_BLOCK = 512  # queries answered in one pass over the signatures
KNOWN_TERMS = 500_000  # whose hash a worker remembers; beyond it starts anew
FLUSH_TERMS = 200_000  # document frequencies held before they are written

# A-Z become lower case, all other ASCII but digits and a-z parts terms.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_U = np.uint64


def terms(data: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return (data or b"").translate(_FOLD).split()


class Hashes(dict):
    """The 64-bit hash of a term, remembered."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= KNOWN_TERMS:
            self.clear()
        h = self[term] = xxhash.xxh3_64_intdigest(term)
        return h


def slices(hashes: np.ndarray, level: np.ndarray | int, width: int) -> np.ndarray:
    """The slices, one row per item, that a term sets at an occurrence level in signatures of a width."""
    x = hashes + _U(0x9E3779B97F4A7C15) * np.asarray(level, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    step = (x >> _U(32)) | _U(1)
    return ((x[:, None] + step[:, None] * np.arange(HASHES, dtype=_U)) & _U(width - 1)).astype(np.int64)


# ---------------------------------------------------------------- index

class _Class:
    """Documents whose signatures have the same width, until they fill a block."""

    def __init__(self, width: int):
        self.width, self.most = width, max(8, min(BLOCK_DOCS, BLOCK_CELLS // width))
        self.ids, self.hashes, self.sizes, self.items, self.levels = [], [], [], [], []

    def block(self) -> dict:
        cells = np.zeros((self.width, -(-len(self.ids) // 8) * 8), bool)
        doc = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.items])
        cells[slices(np.concatenate(self.items), np.concatenate(self.levels), self.width), doc[:, None]] = True
        out = {"width": self.width, "ids": self.ids, "hashes": self.hashes, "sizes": self.sizes, "bits": np.packbits(cells, axis=1).tobytes()}
        self.ids, self.hashes, self.sizes, self.items, self.levels = [], [], [], [], []
        return out


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The signatures of all documents with a term, in blocks, and document frequencies, in parts.

    A document inserts each of its terms once per occurrence level that it reaches, so
    that presence at a level bounds the number of occurrences. Documents meet others of
    a like number of items in a block, and its signatures are as wide as these need: a long
    text does not fill up, a short one does not waste. A block is stored slice by slice: row s
    is a bitmap of the documents with bit s. Everything a partition holds at once is bounded.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("hash"), F.col(text_col).cast("binary").alias("text"))
    id_type = raw.schema["doc_id"].dataType.simpleString()
    schema = f"width int, ids array<{id_type}>, hashes array<long>, sizes array<long>, bits binary, terms array<binary>, found array<long>"

    def built(batches):
        hashes, classes, found, arrow = Hashes(), {}, Counter(), None

        def row(**kw):
            types = {"width": pa.int32(), "ids": pa.list_(arrow), "hashes": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "bits": pa.binary(),
                     "terms": pa.list_(pa.binary()), "found": pa.list_(pa.int64())}
            return pa.RecordBatch.from_pydict({c: pa.array([kw.get(c)], t) for c, t in types.items()})

        for b in batches:
            arrow = b.column("doc_id").type
            for i, h, t in zip(b.column("doc_id"), b.column("hash"), b.column("text")):
                words = terms(t.as_py())
                if not words:
                    continue
                counts = Counter(words)
                found.update(counts.keys())
                x = np.fromiter(map(hashes.__getitem__, counts), _U, len(counts))
                reached = np.searchsorted(LEVELS, np.fromiter(counts.values(), np.int64, len(counts)), "right")
                items = np.repeat(x, reached)
                levels = np.arange(len(items)) - np.repeat(np.cumsum(reached) - reached, reached)
                width = max(64, 1 << (BITS * len(items) - 1).bit_length())
                c = classes.setdefault(width, _Class(width))
                c.ids.append(i.as_py())
                c.hashes.append(h.as_py())
                c.sizes.append(len(words))
                c.items.append(items)
                c.levels.append(levels)
                if len(c.ids) >= c.most:
                    yield row(**c.block())
                if len(found) >= FLUSH_TERMS:
                    yield row(terms=list(found.keys()), found=list(found.values()))
                    found.clear()
        for c in classes.values():
            if c.ids:
                yield row(**c.block())
        if found:
            yield row(terms=list(found.keys()), found=list(found.values()))

    return raw.mapInArrow(built, schema)


def totals(signatures: DataFrame) -> tuple[int, int]:
    """Number of documents with a term, and of all their terms."""
    r = signatures.where("width IS NOT NULL").agg(F.sum(F.size("sizes")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    return r["n"] or 0, r["l"] or 0


# ---------------------------------------------------------------- scores

class Queries:
    """A block of queries: numbers, their terms and the terms' weights."""

    def __init__(self, numbered: list[tuple[int, list[bytes]]]):
        self.numbers = [n for n, _ in numbered]
        self.terms = sorted({t for _, ts in numbered for t in ts})
        at = {t: i for i, t in enumerate(self.terms)}
        self.of = [sorted({at[t] for t in ts}) for _, ts in numbered]
        self.weights = np.zeros(len(self.terms))
        self.n = self.l = 0

    def weigh(self, found: dict[bytes, int], n: int, l: int) -> None:
        """Weights by document frequency; a term that no document holds weighs nothing."""
        self.n, self.l = n, l
        self.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * found[t] + 1))) if t in found else 0 for t in self.terms], float)

    def spread(self, length):
        """m of documents of so many terms: 100 for the mean length."""
        return 50 + (50 * length * self.n) // self.l

    def bounds(self, block: dict) -> np.ndarray:
        """Upper bounds of the scores of a block's documents, one row per query: integers, exact as doubles.

        A term's slices, combined by AND, overestimate which documents hold it at a level; a
        document that stops at a level has fewer occurrences than the next level asks for.
        """
        size = len(block["ids"])
        rows = np.frombuffer(block["bits"], np.uint8).reshape(block["width"], -1)
        m = self.spread(np.array(block["sizes"], np.int64))
        most = np.array([b - 1 for b in LEVELS[1:]] + [2 ** 31], np.int64)
        worth = np.zeros((len(self.terms), size))
        live, bits = np.arange(len(self.terms)), None
        hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in self.terms], _U)
        for level in range(len(LEVELS)):
            now = np.bitwise_and.reduce(rows[slices(hashes[live], level, block["width"])], axis=1)
            bits = now if bits is None else bits & now
            some = bits.any(axis=1)
            live, bits = live[some], bits[some]
            if not len(live):
                break
            here = np.unpackbits(bits, axis=1, count=size).astype(bool)
            share = (ONE * most[level]) // (1000 * most[level] + 20 * m)
            worth[live] = np.where(here, self.weights[live, None] * share, worth[live])
        asked = np.zeros((len(self.of), len(self.terms)))
        for q, at in enumerate(self.of):
            asked[q, at] = 1
        return asked @ worth

    def exact(self, q: int, length: int, counts: Counter) -> int:
        m = self.spread(length)
        return sum(int(self.weights[t]) * ((ONE * tf) // (1000 * tf + 20 * m)) for t in self.of[q] if (tf := counts.get(self.terms[t])))


def _blocks(batches):
    for b in batches:
        yield from b.select(["width", "ids", "hashes", "sizes", "bits"]).to_pylist()


def _emit(parts: list[tuple[np.ndarray, np.ndarray, list, list, np.ndarray]], numbers, arrow_type):
    q, d, ids, hashes, bound = ([x for p in parts for x in p[i]] for i in range(5)) if parts else ([], [], [], [], [])
    return pa.RecordBatch.from_pydict({"number": pa.array([numbers[i] for i in q], pa.int64()), "doc_id": pa.array(ids, arrow_type), "hash": pa.array(hashes, pa.int64()),
                                       "bound": pa.array([int(x) for x in bound], pa.int64())})


def candidates(signatures: DataFrame, queries: Queries, k: int | None, least: np.ndarray | None = None) -> DataFrame:
    """``number, doc_id, hash, bound``: the k highest bounds of each partition, or all bounds of at least the query's threshold.

    A document's bound must also be above 0, as must its score.
    """
    id_type = signatures.schema["ids"].dataType.elementType.simpleString()

    def best(batches):
        arrow, kept = None, None
        for b in batches:
            arrow = b.schema.field("ids").type.value_type
            for block in _blocks([b]):
                bound = queries.bounds(block)
                ids, hashes = block["ids"], block["hashes"]
                if least is not None:
                    q, d = np.nonzero((bound >= least[:, None]) & (bound > 0))
                    if len(q):
                        yield _emit([(q, d, [ids[x] for x in d], [hashes[x] for x in d], bound[q, d])], queries.numbers, arrow)
                    continue
                where = np.arange(len(ids))
                if kept is not None:  # the best so far stand before this block's documents
                    bound = np.hstack([kept[0], bound])
                top = np.argpartition(-bound, min(k, bound.shape[1]) - 1, axis=1)[:, :k]
                old = kept[1] if kept is not None else [[] for _ in queries.of]
                shift = kept[0].shape[1] if kept is not None else 0
                kept = (np.take_along_axis(bound, top, 1),
                        [[old[q][x] if x < shift else (ids[where[x - shift]], hashes[where[x - shift]]) for x in row] for q, row in enumerate(top.tolist())])
        if kept is not None:
            q, d = np.nonzero(kept[0] > 0)
            picked = [kept[1][i][j] for i, j in zip(q.tolist(), d.tolist())]
            yield _emit([(q, d, [p[0] for p in picked], [p[1] for p in picked], kept[0][q, d])], queries.numbers, arrow)

    blocks = signatures.where("width IS NOT NULL").select("width", "ids", "hashes", "sizes", "bits")
    return blocks.mapInArrow(best, f"number long, doc_id {id_type}, hash long, bound long")


def rescored(found: DataFrame, docs: DataFrame, queries: Queries, small: bool, id_col: str, text_col: str) -> DataFrame:
    """``number, doc_id, score`` of candidates, from their whole texts. Every row of a repeated document is scored."""
    per_doc = found.groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).agg(F.collect_set("number").alias("numbers"))  # at most a block of queries
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("hash"), F.col(text_col).cast("binary").alias("text"))
    joined = texts.join(F.broadcast(per_doc) if small else per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    at = {n: q for q, n in enumerate(queries.numbers)}
    wanted = set(queries.terms)

    def scored(batches):
        for b in batches:
            number, row, score = [], [], []
            for i, (t, numbers) in enumerate(zip(b.column("text"), b.column("numbers").to_pylist())):
                words = terms(t.as_py())
                counts = Counter(w for w in words if w in wanted)
                for n in numbers:
                    s = queries.exact(at[n], len(words), counts)
                    if s > 0:
                        number.append(n)
                        row.append(i)
                        score.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(score, pa.int64())],
                                             names=["number", "doc_id", "score"])

    return joined.select("doc_id", "text", "numbers").mapInArrow(scored, f"number long, doc_id {id_type}, score long")


def _first(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
           signatures: DataFrame | None = None) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k highest-scoring documents with a score above 0.

    ``signatures`` is a stored ``index(docs)``; without it the documents are indexed here.

    Queries are answered in blocks of bounded number, each in two passes over the
    signatures. The first takes the k documents of highest bound and scores them exactly; the
    k-th score is what any other document must reach. The second takes every document whose
    bound reaches it, also in a tie, and scores those exactly. Only the first pass's
    texts, k per query, are met by a broadcast; the second's are a plain join.

    A null text, of a document or an item, has no terms. Repeated documents are found each
    for itself; repeated items have a list each. Equal scores are ranked by id, null ids last.
    Empty tables give no rows.
    """
    signatures = cut(index(docs, id_col, text_col)) if signatures is None else signatures
    n, l = totals(signatures)
    numbered = cut(items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("binary").alias("text"), F.monotonically_increasing_id().alias("number")))
    answers = []
    for block in batched(numbered.select("number", "text").toLocalIterator(), QUERY_BLOCK):
        queries = Queries([(r["number"], terms(bytes(r["text"]) if r["text"] is not None else None)) for r in block])
        if not queries.terms or not n:
            continue
        queries.weigh(_frequencies(signatures, queries.terms), n, l)
        top = Window.partitionBy("number").orderBy(F.desc("bound"))
        first = candidates(signatures, queries, k).withColumn("_at", F.row_number().over(top)).where(F.col("_at") <= k).drop("_at")
        sure = _first(rescored(first, docs, queries, True, id_col, text_col), k)
        at = {x: i for i, x in enumerate(queries.numbers)}
        least = np.zeros(len(at))
        for r in sure.where(F.col("rank") == k).select("number", "score").collect():  # at most one row per query of the block
            least[at[r["number"]]] = r["score"]
        # Whatever the thresholds let through is written once and read by its texts' join.
        reach = cut(candidates(signatures, queries, None, least).select("number", "doc_id", "hash").distinct())
        answers.append(cut(_first(rescored(reach, docs, queries, False, id_col, text_col), k)))
    if not answers:
        answers = [items.sparkSession.createDataFrame([], f"number long, doc_id {docs.schema[id_col].dataType.simpleString()}, score long, rank int")]
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out.join(numbered.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


def _frequencies(signatures: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """Document frequencies of a block's terms: parts are summed where they were counted, then over all."""
    asked = set(wanted)

    def picked(batches):
        for b in batches:
            t, f = b.column("terms").flatten().to_pylist(), b.column("found").flatten().to_pylist()
            hit = [(x, n) for x, n in zip(t, f) if x in asked]
            yield pa.RecordBatch.from_pydict({"term": pa.array([x for x, _ in hit], pa.binary()), "n": pa.array([n for _, n in hit], pa.int64())})

    parts = signatures.where("terms IS NOT NULL").select("terms", "found").mapInArrow(picked, "term binary, n long")
    return {bytes(r["term"]): r["n"] for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most one row per term of the block
