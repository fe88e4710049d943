"""SNK3: a table of newest rows per key on shared storage, changed bucket by bucket (copy on write)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BUCKETS = 64


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def committed_versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed manifests, oldest first; one whose write was cut short has no success mark."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    success = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{n}/_SUCCESS")
    return sorted(n for n in names if fs.exists(success(n)))


def _entries(spark: SparkSession, path: str, version: str | None) -> dict[int, str]:
    """Which batch wrote the current rows of each bucket; at most one entry per bucket."""
    if version is None:
        return {}
    return {r["bucket"]: r["batch"] for r in spark.read.schema("bucket int, batch string").parquet(f"{path}/manifest/{version}").collect()}


def _rows(spark: SparkSession, path: str, entries: dict[int, str], schema) -> DataFrame | None:
    held: dict[str, list[int]] = {}
    for bucket, batch in entries.items():
        held.setdefault(batch, []).append(bucket)
    parts = [spark.read.schema(schema).parquet(f"{path}/rows/{batch}").where(F.col("bucket").isin(buckets)) for batch, buckets in held.items()]
    return reduce(DataFrame.unionByName, parts) if parts else None


def upsert_into(fresh: DataFrame, path: str, key: str, order: list[str], batch: str) -> list[int]:
    """Brings fresh rows into the table at ``path`` and returns the buckets it rewrote.

    The newest row per key stays, by the ``order`` columns and then by the whole row, so ties
    give one result. Only buckets that hold a key of the batch are read and written anew, under
    the batch's own folder; then a new manifest names the folder of every bucket. Readers
    follow the newest committed manifest and so see all of a batch or nothing of it. A run
    that dies before its manifest leaves a folder that its repetition overwrites; a batch that
    was committed before changes nothing. There is one writer at a time. A null key is a key.
    """
    spark = fresh.sparkSession
    versions = committed_versions(spark, path)
    if any(v.split("-", 1)[1] == batch for v in versions):
        return []
    marked = fresh.withColumn("bucket", _bucket(key))
    touched = sorted(r["bucket"] for r in marked.select("bucket").distinct().collect())  # at most BUCKETS numbers
    if not touched:
        return []
    entries = _entries(spark, path, versions[-1] if versions else None)
    stored = _rows(spark, path, {b: e for b, e in entries.items() if b in touched}, marked.schema)
    rest = [c for c in fresh.columns if c != key]
    rank = F.struct(*order, *[c for c in rest if c not in order])
    newest = (marked if stored is None else stored.unionByName(marked)).groupBy("bucket", key).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
    newest.select(key, "_r.*", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/{batch}")
    now = entries | dict.fromkeys(touched, batch)
    number = int(versions[-1].split("-", 1)[0]) + 1 if versions else 0
    spark.createDataFrame(sorted(now.items()), "bucket int, batch string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{number:010d}-{batch}")
    return touched


def _with_bucket(schema):
    return f"{schema}, bucket int" if isinstance(schema, str) else T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table's rows as the newest committed manifest has them; none where nothing was committed."""
    versions = committed_versions(spark, path)
    rows = _rows(spark, path, _entries(spark, path, versions[-1] if versions else None), _with_bucket(schema))
    return spark.createDataFrame([], schema) if rows is None else rows.drop("bucket")
