"""Stored history of a stream: rows by bucket, in segments that are merged level by level (STR6-STR8).

A micro-batch adds one segment. ``FAN`` segments of a level become one of the next, so after n
batches there are at most ``FAN`` times log n of them and a row was rewritten log n times. A
manifest names the live segments and is switched as a whole: readers see a segment and what it
was merged from never together, and a writer that dies before the switch has changed nothing.
There is one writer at a time.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import membership
from .keyed_table import committed_versions

BUCKETS = 64
FAN = 8
FILE_ROWS = 1_000_000  # rows of a bucket that are written by one task


class Segment(NamedTuple):
    name: str
    level: int
    buckets: list[int]


class State(NamedTuple):
    version: int
    segments: list[Segment]
    done: dict[str, int]  # newest batch of each run; a run's batches come in order


MANIFEST = "name string, level int, buckets array<int>, run string, done bigint"


def state(spark: SparkSession, path: str) -> State:
    """What the newest committed manifest says; nothing where none was committed."""
    versions = committed_versions(spark, path)
    if not versions:
        return State(-1, [], {})
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{versions[-1]}").collect()  # segments and runs, no data
    return State(int(versions[-1]), [Segment(r.name, r.level, r.buckets) for r in rows if r.run is None], {r.run: r.done for r in rows if r.run is not None})


def _commit(spark: SparkSession, path: str, now: State) -> None:
    rows = [(s.name, s.level, s.buckets, None, None) for s in now.segments] + [(None, None, None, run, done) for run, done in now.done.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{now.version:010d}")


def bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))


def sizes(marked: DataFrame) -> dict[int, int]:
    """Rows per bucket: at most ``BUCKETS`` numbers."""
    return {r["bucket"]: r["count"] for r in marked.groupBy("bucket").count().collect()}


def _salt(df: DataFrame, rows: dict[int, int]) -> Column:
    """Spreads a bucket of more than ``FILE_ROWS`` rows, such as that of a hot key, over several tasks."""
    wide = {b: -(-n // FILE_ROWS) for b, n in rows.items() if n > FILE_ROWS}
    if not wide:
        return F.lit(0)
    parts = F.create_map(*[F.lit(x) for pair in wide.items() for x in pair])
    return F.pmod(F.xxhash64(*df.columns), F.coalesce(F.try_element_at(parts, F.col("bucket")), F.lit(1)))


def _write(df: DataFrame, rows: dict[int, int], folder: str) -> None:
    df.repartition("bucket", _salt(df, rows)).write.mode("overwrite").partitionBy("bucket").parquet(folder)


def _folder(path: str, name: str) -> str:
    return f"{path}/rows/segment={name}"


def _filter_folder(path: str, name: str) -> str:
    return f"{path}/filters/segment={name}"


def _write_filter(spark: SparkSession, path: str, name: str, schema, rows: dict[int, int], key: str | None) -> None:
    """A filter over a segment's keys, read back from its files: one column of them. Live with the manifest that names the segment."""
    if key is None or not rows:
        return
    marked = T.StructType([schema[key], T.StructField("bucket", T.IntegerType())])
    stored = spark.read.schema(marked).parquet(_folder(path, name))
    membership.build(stored, key, rows).write.mode("overwrite").parquet(_filter_folder(path, name))


def may_hold(asked: DataFrame, path: str, key: str) -> DataFrame:
    """The rows of ``asked(key, bucket)`` that the history may hold by its filters (:mod:`.membership`); it surely lacks the others.

    All rows where a live segment has no filter, as it was appended without ``key``.
    """
    spark = asked.sparkSession
    names = [s.name for s in state(spark, path).segments if s.buckets]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folders = [_filter_folder(path, n) for n in names]
    if any(not hadoop(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(f)) for f in folders):
        return asked
    return membership.may_hold(asked, key, spark.read.schema(membership.FILTER).parquet(*folders)) if folders else asked.limit(0)


def _rows(spark: SparkSession, path: str, schema, segments: list[Segment], buckets) -> DataFrame:
    wanted = None if buckets is None else set(buckets)
    held = [s for s in segments if s.buckets and (wanted is None or wanted & set(s.buckets))]
    marked = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    if not held:
        return spark.createDataFrame([], marked)
    stored = T.StructType([*schema.fields, T.StructField("segment", T.StringType()), T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(stored).option("basePath", f"{path}/rows").parquet(*[_folder(path, s.name) for s in held]).drop("segment")
    return rows if wanted is None else rows.where(F.col("bucket").isin(sorted(wanted)))


def read(spark: SparkSession, path: str, schema: T.StructType | None = None, buckets=None) -> DataFrame:
    """Rows of all live segments, of the given buckets only where these are named; with their ``bucket``.

    A history that has no rows yet needs the schema named; else the files tell it.
    """
    segments = state(spark, path).segments
    if schema is None:
        first = spark.read.parquet(*[_folder(path, s.name) for s in segments if s.buckets][:1])
        schema = T.StructType([f for f in first.schema.fields if f.name != "bucket"])
    return _rows(spark, path, schema, segments, buckets)


def is_committed(spark: SparkSession, path: str, run: str, batch_id: int) -> bool:
    return state(spark, path).done.get(run, -1) >= batch_id


def append(marked: DataFrame, path: str, run: str, batch_id: int, rows: dict[int, int] | None = None, combine=None, key: str | None = None) -> None:
    """Adds a batch of :func:`bucketed` rows as a segment; then one due merge is done.

    ``rows`` bounds the rows per bucket (:func:`sizes` of the batch, or of what it came from). A
    batch that was committed before changes nothing; one that died is written over. ``combine``
    may shrink the rows of merged segments and must keep ``bucket``; it gets all merged rows of
    a key together, but not those of segments that stay. With a ``key`` each segment gets a filter
    over that column, for :func:`may_hold`.
    """
    spark = marked.sparkSession
    was = state(spark, path)
    schema = T.StructType([f for f in marked.schema.fields if f.name != "bucket"])
    if was.done.get(run, -1) < batch_id:
        rows = sizes(marked) if rows is None else rows
        fresh = []
        if rows:
            name = f"{run}-{batch_id}"
            _write(marked, rows, _folder(path, name))
            _write_filter(spark, path, name, schema, rows, key)
            fresh = [Segment(name, 0, sorted(rows))]
        was = State(was.version + 1, was.segments + fresh, was.done | {run: batch_id})
        _commit(spark, path, was)
    merge(spark, path, schema, combine, key)


def merge(spark: SparkSession, path: str, schema: T.StructType, combine=None, key: str | None = None) -> bool:
    """Merges the lowest level that has ``FAN`` segments; says whether one had."""
    was = state(spark, path)
    full = [level for level in sorted({s.level for s in was.segments}) if sum(s.level == level for s in was.segments) >= FAN]
    if not full:
        return False
    old = [s for s in was.segments if s.level == full[0]]
    rows = _rows(spark, path, schema, old, None)
    counts = sizes(rows)  # buckets are folders: no column is read for this
    name = f"merged-{was.version + 1}"
    _write(combine(rows) if combine else rows, counts, _folder(path, name))
    _write_filter(spark, path, name, schema, counts, key)
    merged = Segment(name, full[0] + 1, sorted(counts))
    _commit(spark, path, State(was.version + 1, [s for s in was.segments if s not in old] + [merged], was.done))
    return True


def remove_merged(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes segments that none of the last ``keep`` manifests names, and the older manifests; returns the segments.

    Readers hold the manifest they began with, so ``keep`` must cover the commits made while
    the longest of them runs. Nothing calls this by itself; run it between batches, since it
    also removes what a writer that died had left.
    """
    versions = committed_versions(spark, path)
    live = {s for v in versions[-keep:] for s in (r["name"] for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{v}").where("name IS NOT NULL").collect())}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(f"{path}/rows")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for v in versions[:-keep]:
        fs.delete(hadoop(f"{path}/manifest/{v}"), True)
    if not versions or not fs.exists(folder):
        return []
    names = [s.getPath().getName().removeprefix("segment=") for s in fs.listStatus(folder)]
    gone = sorted(n for n in names if n not in live)
    for n in gone:
        fs.delete(hadoop(_folder(path, n)), True)
        fs.delete(hadoop(_filter_folder(path, n)), True)
    return gone
