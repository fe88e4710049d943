"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide."""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import BLANKS, cut

N = 5  # words in an n-gram
THRESHOLD = 0.8
RECALL = 0.9999  # of pairs at the threshold; higher above it
MAX_HASHES = 128
TILE_TEXTS, TILE_CHARS = 1024, 4_000_000  # of one side of a tile, on average
SALTS = 256  # tasks over which the rows of a tiled group meet its number of tiles
COLUMNS = 4096  # n-grams multiplied at once
_MULT = np.uint64(0x9E3779B97F4A7C15)


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """The most rows per band, so the fewest false candidates, whose bands reach the recall within so many hashes.

    A pair of similarity s shares one of b bands of r rows with probability 1 - (1 - s**r)**b.
    """
    found = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for r in range(1, most + 1):
        b = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold ** r)))
        if b * r <= most:
            found = (b, r)
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams.

    Words are runs of other characters than ASCII white space, as they are written. A text
    of fewer words than n is one n-gram of all its words; one without words has none.
    """
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        out = _mixed(out * _MULT + h[i:len(h) - width + 1 + i] + np.uint64(i))
    return np.unique(out)


def _signer(bands: int, rows: int):
    rng = np.random.default_rng(7)
    odd = rng.integers(0, 2 ** 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2 ** 63, bands * rows, dtype=np.uint64)

    def sign(grams: np.ndarray) -> list[int]:
        low = np.full(bands * rows, np.iinfo(np.uint64).max)
        for s in range(0, len(grams), 512):
            x = grams[s:s + 512, None] * odd + add
            np.minimum(low, (x ^ (x >> np.uint64(29))).min(axis=0), out=low)
        digest = np.arange(bands, dtype=np.uint64)
        for r in range(rows):
            digest = _mixed(digest * _MULT + low[r::rows])
        return digest.view(np.int64).tolist()

    return sign


def key_of(grams: np.ndarray) -> bytes | None:
    """Names a set of n-grams; texts with equal sets share it, a text without words has none."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def signatures(docs: DataFrame, bands: int, rows: int, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, chars, key, bands``: the name of each text's n-gram set and its band hashes."""
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"), F.char_length(text_col).cast("long").alias("chars"))

    def signed(batches):
        sign = _signer(bands, rows)
        for b in batches:
            keys, hashes = [], []
            for t in b.column("text"):
                grams = ngrams(t.as_py(), n)
                keys.append(key_of(grams))
                hashes.append(sign(grams) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), b.column("chars"), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                                             names=["doc_id", "text_hash", "chars", "key", "bands"])

    return raw.mapInArrow(signed, f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, text_hash long, chars long, key binary, bands array<long>")


def _shared(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the n-grams that occur on both sides."""
    out = np.zeros((len(sets_a), len(sets_b)), np.float32)
    flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
    row_a, row_b = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (sets_a, sets_b))
    if sets_a is sets_b:
        values, counts = np.unique(flat_a, return_counts=True)
        common = values[counts > 1]
        out[np.diag_indices(len(sets_a))] = [len(x) - np.isin(x, common, assume_unique=True).sum() for x in sets_a]
    else:
        common = np.intersect1d(flat_a, flat_b)
    if not len(common):
        return out

    def placed(flat, row):
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        hit = common[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], row[hit][order]

    (col_a, row_a), (col_b, row_b) = placed(flat_a, row_a), placed(flat_b, row_b)
    for c in range(0, len(common), COLUMNS):
        blocks = []
        for col, row, n in ((col_a, row_a, len(sets_a)), (col_b, row_b, len(sets_b))):
            lo, hi = np.searchsorted(col, [c, c + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(common) - c)), np.float32)
            m[row[lo:hi], col[lo:hi] - c] = 1
            blocks.append(m)
        out += blocks[0] @ blocks[1].T
    return out


def _similarities(sets_a, sets_b) -> np.ndarray:
    shared = _shared(sets_a, sets_b).astype(np.float64)
    sizes = [np.array([len(x) for x in s], np.float64) for s in (sets_a, sets_b)]
    return shared / np.maximum(sizes[0][:, None] + sizes[1][None, :] - shared, 1)


def _components(linked: np.ndarray) -> np.ndarray:
    """The smallest index in each row's component of a symmetric Boolean matrix."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


TO_LEADER = "key binary, leader binary, near boolean"


def _to_leader(pdf: pd.DataFrame, n: int, near: float) -> pd.DataFrame:
    """Which texts of a part of a group are within the inner radius of its leader."""
    pdf = pdf.drop_duplicates("key").reset_index(drop=True)
    is_leader = (pdf["key"] == pdf["leader"]).to_numpy()
    sets = [ngrams(t, n) for t in pdf["text"]]
    lead = int(np.flatnonzero(is_leader)[0])
    sim = _similarities(sets, [sets[lead]])[:, 0]
    return pd.DataFrame({"key": pdf["key"], "leader": pdf["leader"], "near": sim >= near - 1e-12})


COUNTED = "key binary, links long, other binary"


def _within(pdf: pd.DataFrame, n: int, threshold: float) -> pd.DataFrame:
    """Links of a pair of tiles of a group, counted per text, and one linked text per text.

    A pair is counted where its smallest common leader's group is compared, once; pairs of
    one core are counted elsewhere.
    """
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    leader = pdf["leader"].iloc[0]
    pdf = pdf.drop_duplicates("key").reset_index(drop=True)
    sets = [ngrams(t, n) for t in pdf["text"]]
    keys, weight, tile = pdf["key"].tolist(), pdf["weight"].to_numpy(np.int64), pdf["tile"].to_numpy()
    core = pd.factorize(pdf["core"])[0]
    # Only leaders before this group's can take a pair away from it.
    before = [frozenset(x for x in ls if x < leader) for ls in pdf["leaders"]]
    side_a, side_b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    links = np.zeros(len(keys), np.int64)
    linked = np.zeros((len(keys), len(keys)), bool)
    if len(side_a) and len(side_b):
        a = [sets[x] for x in side_a]
        b = a if i == j else [sets[x] for x in side_b]
        close = _similarities(a, b) >= threshold - 1e-12
        close &= core[side_a][:, None] != core[side_b][None, :]
        if i == j:
            np.fill_diagonal(close, False)
        linked[np.ix_(side_a, side_b)] = close
        linked |= linked.T
        for x in np.flatnonzero(linked.any(axis=1)):
            partners = np.flatnonzero(linked[x])
            if before[x]:
                partners = np.array([y for y in partners if not before[x] & before[y]], np.int64)
            links[x] = weight[partners].sum() if len(partners) else 0
    root = _components(linked)
    keep = (links > 0) | (root != np.arange(len(keys)))
    return pd.DataFrame({"key": [k for k, t in zip(keys, keep) if t], "links": links[keep], "other": [keys[r] for r in root[keep]]})


def components(edges: DataFrame) -> DataFrame:
    """``key, root`` of every key in undirected edges ``key, other``; the root is the component's smallest key.

    Each round a key takes the smallest root of its neighbours, then its root's root. Every
    round is written to the checkpoint folder, and the rounds end when none changes.
    """
    both = edges.select("key", "other").union(edges.select(F.col("other").alias("key"), F.col("key").alias("other"))).where("key <> other").distinct()
    both = cut(both)
    labels = cut(both.groupBy("key").agg(F.least(F.first("key"), F.min("other")).alias("root")))
    while True:
        heard = both.join(labels.select(F.col("key").alias("other"), F.col("root").alias("said")), "other").groupBy("key").agg(F.min("said").alias("said"))
        told = labels.join(heard, "key").select("key", F.col("root").alias("was"), F.least("root", "said").alias("root"))
        jump = labels.select(F.col("key").alias("root"), F.col("root").alias("further"))
        step = cut(told.join(jump, "root", "left").select("key", "was", F.least("root", "further").alias("root")))
        moved = step.where("root < was").limit(1).count()
        labels = step.select("key", "root")
        if not moved:
            return labels


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, copy_id, n_links`` per document.

    Two documents are linked when the Jaccard similarity of their sets of word n-grams is at
    least the threshold. ``n_links`` is the number of other documents linked to this one,
    copies included; ``class_id`` the smallest id among all documents reachable over links;
    ``copy_id`` the smallest id among those with the same set.

    1. Texts with equal sets are one node. Nodes sign their sets; equal bands make buckets, and
       the smallest node of a bucket leads it. A node's leaders are at most its bands.
    2. Every node is compared with its leaders on full sets. Nodes within half the distance of
       a leader form its core (the first such leader counts). Jaccard distance is a metric, so
       all nodes of a core are linked, and their links are counted without pairing them.
    3. Pairs of a leader's group that are not of one core are compared on full sets in tiles of
       bounded size, and counted at their smallest common leader. A tile returns counts and one
       link per node, never its pairs. Every pair that shares a bucket shares its leader, so
       this covers all candidates.

    A null, empty or blank text has no n-grams and is linked to nothing; its class is its own
    id. Repeated rows are copies of each other. Null ids are ignored when a class takes its
    smallest id; a class of none but null ids has a null id. An empty table gives no rows.
    """
    rows = _classed(docs, threshold, n, recall, id_col, text_col)
    return rows.select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                       F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _classed(docs: DataFrame, threshold: float, n: int, recall: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, root, class_id, copy_id, n_links`` per document; the last four are null without n-grams."""
    bands, rows = bands_and_rows(threshold, recall)
    signed = cut(signatures(docs, bands, rows, n, id_col, text_col))
    source = F.min(F.struct("doc_id", "text_hash", "chars")).alias("source")  # a row that has the node's text
    nodes = signed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("bands").alias("bands"), source)
    nodes = cut(nodes)
    spread = nodes.select("key", F.explode("bands").alias("band"))
    led = spread.groupBy("band").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    followed = spread.join(led, "band").groupBy("key").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))
    members = cut(nodes.select("key", "weight", "source").join(followed, "key"))
    texts = cut(_texts(docs, members, n, id_col, text_col))

    # Tiles are worked out from rows without texts; a text is met by its unique key once its tile is known.
    each = members.select("key", F.explode("leaders").alias("leader"), F.col("source.chars").alias("chars"))
    tiled = _tiled(each)
    cells = tiled.select("leader", "tile").distinct().select("leader", "tile", F.col("leader").alias("key"))
    to_leader = tiled.where("key <> leader").select("leader", "tile", "key").unionByName(cells)
    near = cut(to_leader.join(texts, "key").select("leader", "tile", "key", "text").groupBy("leader", "tile").applyInPandas(
        lambda pdf: _to_leader(pdf, n, 1 - (1 - threshold) / 2), TO_LEADER).where("near"))
    cores = near.groupBy("key").agg(F.min("leader").alias("core"))
    core_of = cut(members.select("key", "weight", "leaders").join(cores, "key", "left").withColumn("core", F.coalesce("core", "key")))
    core_size = core_of.groupBy("core").agg(F.sum("weight").alias("core_weight"))

    mixed = cut(tiled.select("key", "leader", "tiles").join(core_of.select("key", "core"), "key").groupBy("leader").agg(
        F.min("core").alias("a"), F.max("core").alias("z"), F.max("tiles").alias("tiles")).where("a < z").select("leader", "tiles"))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    # A group of one tile is small; the rows of larger ones meet their leader by salt, as in _tiled.
    few = tiled.where("tiles = 1").join(mixed.where("tiles = 1"), "leader", "left_semi")
    many = _salted(tiled.where("tiles > 1")).join(_copied(mixed.where("tiles > 1")).select("leader", "salt"), ["leader", "salt"], "left_semi").drop("salt")
    pairs = few.unionByName(many).withColumn("with", F.explode(every)).select(
        "leader", "key", "tile", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"))
    pairs = pairs.join(core_of.select("key", "weight", "leaders", "core").join(texts, "key"), "key")
    compared = cut(pairs.groupBy("leader", "i", "j").applyInPandas(lambda pdf: _within(pdf, n, threshold), COUNTED))
    # A core is a star already: only links between cores are left to follow.
    named = core_of.select("key", "core")
    between = compared.select("key", "other").join(named, "key").join(named.select(F.col("key").alias("other"), F.col("core").alias("other_core")), "other")
    roots = components(between.select(F.col("core").alias("key"), F.col("other_core").alias("other")))
    outside = compared.groupBy("key").agg(F.sum("links").alias("outside"))

    # Nodes without candidates are cores of their own; a null core would bring them all to one task.
    own = nodes.select("key", "rep", "weight").join(core_of.select("key", "core"), "key", "left").withColumn("core", F.coalesce("core", "key"))
    per_core = core_size.join(roots.withColumnRenamed("key", "core"), "core", "left")
    about = own.join(per_core, "core", "left").join(outside, "key", "left").withColumn("root", F.coalesce("root", "core"))
    about = cut(about.select("key", "rep", "root", (F.coalesce("core_weight", "weight") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links")))
    classes = about.groupBy("root").agg(F.min("rep").alias("class_id"))
    per_node = about.join(classes, "root").select("key", "root", "class_id", F.col("rep").alias("copy_id"), "n_links")
    with_grams, without = signed.where("key IS NOT NULL"), signed.where("key IS NULL")
    rest = [F.lit(None).cast(per_node.schema[c].dataType).alias(c) for c in ("root", "class_id", "copy_id", "n_links")]
    return with_grams.select("doc_id", "text_hash", "key").join(per_node, "key").drop("key").unionByName(without.select("doc_id", "text_hash", *rest))


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS)))


def _copied(leaders: DataFrame) -> DataFrame:
    return leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _tiled(each: DataFrame) -> DataFrame:
    """Adds ``tiles`` of the leader and the row's ``tile`` to rows (key, leader, chars).

    Few groups need more than one tile. Their numbers are copied once per salt, and the rows
    meet them by leader and salt, so the rows of one large group are spread over tasks.
    """
    size = F.greatest(F.ceil(F.count(F.lit(1)) / TILE_TEXTS), F.ceil(F.sum("chars") / TILE_CHARS)).cast("int").alias("tiles")
    large = _copied(each.groupBy("leader").agg(size).where("tiles > 1"))
    out = _salted(each).join(large, ["leader", "salt"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    return cut(out.select("key", "leader", "tiles", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int").alias("tile")))


def _texts(docs: DataFrame, members: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``key, text`` of every node with candidates, from the row that the node names by id and hash of the text.

    Rows that agree in both are checked against the key, as two texts may share a hash.
    """
    wanted = members.select("key", F.col("source.doc_id").alias("_id"), F.col("source.text_hash").alias("_hash"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    joined = wanted.join(texts, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))).select("key", "text")

    def kept(batches):
        for b in batches:
            yield b.filter(pa.array([key_of(ngrams(t.as_py(), n)) == k.as_py() for t, k in zip(b.column("text"), b.column("key"))], pa.bool_()))

    return joined.mapInArrow(kept, "key binary, text string").dropDuplicates(["key"])


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> DataFrame:
    """The documents, one of each class of the join, with all their columns: the one with the smallest id.

    Texts without n-grams are of no class and all stay. Null ids come last in a class; among
    rows of one id the text with the smallest hash stays, and of rows that repeat id and
    text one.
    """
    classed = cut(_classed(docs, threshold, n, recall).where("root IS NOT NULL").select("root", "doc_id", "text_hash"))
    winner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "rows")).alias("w")
    kept = classed.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")).groupBy("root").agg(winner)
    kept = kept.select(F.col("w.doc_id").alias("_id"), F.col("w.text_hash").alias("_text_hash"), F.col("w.rows").alias("_rows"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"))
    wordless = F.trim(F.coalesce(F.col("_row.text"), F.lit("")), F.lit(BLANKS)) == ""
    joined = packed.where(~wordless).join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text_hash")))
    several = joined.where("_rows > 1").dropDuplicates(["_doc", "_hash"])
    return joined.where("_rows = 1").select("_row.*").unionByName(several.select("_row.*")).unionByName(packed.where(wordless).select("_row.*"))
