"""Exact top-k search: tiled matrix products of queries and shards, merged as a tree."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

K = 20
TILE_QUERIES, TILE_SHARD = 512, 4096
CELL_QUERIES, CELL_SHARD = 8_192, 65_536  # rows of one task's input
MERGE_FAN = 16
EXACT = 2.0 ** 53


def quantised(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``vec_id, v, q, copies`` of the rows that take part: v is floor(scale * x) per component, repeated rows are counted."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole numbers already

    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, whole).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    return rows.groupBy("vec_id", "v", "q").agg(F.count(F.lit(1)).alias("copies"))


def _matrix(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles are exact while every partial sum stays below 2**53; beyond that Python integers are."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if bound < EXACT:
        return a @ b.T
    big = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return big(a) @ big(b).T


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """Per row the k highest scores of columns in ascending id order, ties to the smaller id; the own column is left out.

    Partial selection: a score and its column make one number, so no two are equal.
    """
    n = scores.shape[1]
    keep = min(k, n)
    if scores.dtype == object or np.abs(scores).max(initial=0) * n >= EXACT / 2:
        mask = ids[None, :] == own[:, None]
        for i in range(len(scores)):
            order = sorted((j for j in range(n) if not mask[i, j]), key=lambda j: (-int(scores[i, j]), j))[:k]
            yield i, ids[order], [int(scores[i, j]) for j in order]
        return
    key = scores * n + (n - 1 - np.arange(n))
    key[ids[None, :] == own[:, None]] = -np.inf
    part = np.argpartition(-key, keep - 1, axis=1)[:, :keep] if keep < n else np.broadcast_to(np.arange(n), key.shape)
    picked = np.take_along_axis(key, part, 1)
    order = np.take_along_axis(part, np.argsort(-picked, axis=1), 1)
    ok = np.isfinite(np.take_along_axis(key, order, 1))
    for i in range(len(scores)):
        cols = order[i][ok[i]]
        yield i, ids[cols], scores[i, cols].astype(np.int64).tolist()


def _merge(lists, k: int):
    """The k best of several (ids, scores) lists."""
    pairs = sorted(((s, i) for ids, scores in lists for s, i in zip(scores, ids)), key=lambda p: (-p[0], p[1]))[:k]
    return [int(i) for _, i in pairs], [int(s) for s, _ in pairs]


LISTS = "query_id long, row long, copies long, lane int, ids array<long>, scores array<long>"
LONG = 2 ** 63 - 1


def _cell(key, queries: pd.DataFrame, shard: pd.DataFrame, k: int) -> pd.DataFrame:
    """The top lists of one cell: its queries against its part of the rows, tile by tile."""
    if queries.empty or shard.empty:
        return pd.DataFrame({c.split()[0]: [] for c in LISTS.split(", ")})
    shard = shard.loc[shard.index.repeat(np.minimum(shard["copies"], k))].sort_values("vec_id", kind="stable")
    dim = max(max(map(len, queries["v"])), max(map(len, shard["v"])), 1)
    ids = shard["vec_id"].to_numpy(np.int64)
    q_ids = queries["vec_id"].to_numpy(np.int64)
    best: list = [([], [])] * len(queries)
    for s in range(0, len(shard), TILE_SHARD):
        b = _matrix(shard["v"].iloc[s:s + TILE_SHARD].tolist(), dim)
        for q in range(0, len(queries), TILE_QUERIES):
            a = _matrix(queries["v"].iloc[q:q + TILE_QUERIES].tolist(), dim)
            for i, found, scores in _best(_exact_product(a, b), ids[s:s + TILE_SHARD], q_ids[q:q + TILE_QUERIES], k):
                best[q + i] = _merge([best[q + i], (found, scores)], k)
    clip = lambda xs: [max(-LONG, min(LONG, x)) for x in xs]
    return pd.DataFrame({"query_id": q_ids, "row": queries["row"], "copies": queries["copies"], "lane": int(key[1]),
                         "ids": [b[0] for b in best], "scores": [clip(b[1]) for b in best]})


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's k rows of highest integer inner product.

    Components become floor(scale * x). Rows whose id or vector is null, or whose vector
    holds a null or non-finite component, take no part; components that a shorter vector
    lacks count as 0. Every row but those with the query's own id is a candidate, repeated
    rows each for itself; ties go to the smaller id. A score beyond 64 bits is stated as
    the bound of a long. A query row that occurs twice has two lists. Fewer candidates than
    k give all of them; an empty table gives no rows.

    Queries and rows are dealt into a grid whose cells hold at most a fixed number of each
    on average, so the grid grows with both and a task's memory does not. A cell multiplies
    tile by tile and keeps k per query; the lists of the cells of one query are merged in
    groups of 16 until one is left.
    """
    rows = cut(quantised(vectors, is_query, id_col, vector_col, scale).withColumn("row", F.xxhash64("vec_id", "v")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    # Cells are smaller than their bound while there are fewer of them than the session runs tasks.
    lanes = max(-(-size["n"] // CELL_SHARD), min(rows.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // TILE_SHARD)), 1)
    blocks = max(-(-size["q"] // CELL_QUERIES), 1)
    place = lambda n: F.pmod("row", F.lit(n)).cast("int")
    queries = rows.where("q").withColumn("block", place(blocks)).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    shards = rows.withColumn("lane", place(lanes)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Fresh aliases: both sides come from one frame, and a cogroup of its very columns would mix them up.
    dealt = lambda df: df.select(*[F.col(c).alias(c) for c in ("block", "lane", "vec_id", "row", "copies", "v")]).groupBy("block", "lane")
    lists = dealt(queries).cogroup(dealt(shards)).applyInPandas(
        lambda key, a, b: _cell(key, a, b, k), LISTS)
    top = lists.select("query_id", "row", "copies", "lane", F.zip_with("scores", "ids", lambda s, i: F.struct((-s).alias("minus"), i.alias("vec_id"))).alias("top"))
    while True:
        lanes = -(-lanes // MERGE_FAN)
        top = top.groupBy("query_id", "row", "copies", F.floor(F.col("lane") / MERGE_FAN).alias("lane")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if lanes <= 1:
            break
    each = top.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("query_id", F.posexplode("top").alias("_at", "_t")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), F.col("_t.vec_id").alias("vec_id"), (-F.col("_t.minus")).alias("score"))
