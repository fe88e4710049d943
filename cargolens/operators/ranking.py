"""Numbering and latest-row operators that stay balanced when one key is hot."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str, slices: list[Column]) -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order)`` without one task per key.

    ``slices`` are coarse, monotone functions of the order, such as the hour of its time:
    rows of one slice are neighbours in the order, and the slices follow it. A key that
    holds a third of all rows is numbered slice by slice; the rows of earlier slices are
    added as an offset from a table with one row per key and slice. A slice depends on its
    row alone, so a lost executor cannot change it and nothing needs to be written.
    """
    names, cuts = [f"_o{i}" for i in range(len(order))], [f"_s{i}" for i in range(len(slices))]
    sliced = df.select("*", *[o.alias(n) for o, n in zip(order, names)], *[s.alias(n) for s, n in zip(slices, cuts)])
    earlier = Window.partitionBy(*keys).orderBy(*cuts).rowsBetween(Window.unboundedPreceding, -1)
    before = (sliced.groupBy(*keys, *cuts).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    local = F.row_number().over(Window.partitionBy(*keys, *cuts).orderBy(*names))
    return (
        sliced.withColumn("_local", local).join(before, [*keys, *cuts])
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_local", "_before", *cuts, *names)
    )


def latest(df: DataFrame, keys: list[str], order: list[Column], first: bool = False) -> DataFrame:
    """One row per key, the last (or first) by ``order``: an aggregate, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    row = pick(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
