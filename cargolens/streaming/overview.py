"""OVR1-OVR6 as a maintained table: a batch of changes costs what its shipments hold, and a read costs a scan.

The inputs are stored histories in buckets of the key they are looked up by. A batch appends its
changed rows, finds the shipments they touch, works these out by the full form from the buckets
that hold them, and brings the rows into a keyed table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import overview as O
from ..sources import history as H, keyed_table as KT

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def _of(fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])


SHIPMENT = _of("shipment_key string")
VERSION = _of("reg_id long, shipment_key string, doc_type string, email_id string, document_status string, version_number int, is_latest boolean, batch_id long")
ISSUE = _of("issue_key string, shipment_key string, field_name string, status string, batch_id long")
REPORT = _of("report_id long, email_id string, category string, status string, review_reason string, has_defect boolean, batch_id long")
LINK = _of("email_id string, shipment_key string")
OVERVIEW = _of("shipment_key string, missing_documents array<string>, missing_optional array<string>, has_any boolean, complete boolean, mismatch_fields array<string>, "
               "issue_count long, report_status string, report_reason string, status string, reasons array<string>, actions array<string>, batch_id long")
RUN = "overview"


def _shaped(df: DataFrame, schema: T.StructType, batch_id: int) -> DataFrame:
    return df.select(*[(F.lit(batch_id) if f.name == "batch_id" else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _newest(rows: DataFrame, key: str) -> DataFrame:
    """The row of the last batch per key; of several in one batch the greatest, so that a repeated batch gives the same."""
    rest = [c for c in rows.columns if c not in (key, "bucket")]
    order = F.struct("batch_id", *[c for c in rest if c != "batch_id"])
    return rows.groupBy(key, "bucket").agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "bucket", "r.*").select(*rows.columns)


def _of_keys(spark: SparkSession, path: str, schema: T.StructType, keys: DataFrame, column: str) -> DataFrame:
    """The stored rows of some keys, with their bucket: no other bucket is opened."""
    marked = H.bucketed(keys.select(column).distinct(), [column])
    return H.read(spark, path, schema, H.sizes(marked)).join(marked.select(column), column, "left_semi")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maintain(spark: SparkSession, out: str, batch_id: int, shipments: DataFrame | None = None, versions: DataFrame | None = None,
             issues: DataFrame | None = None, reports: DataFrame | None = None) -> None:
    """Brings a batch of new and changed rows into the overview under ``out``; :func:`current` reads it.

    A version (by ``reg_id``), issue (by ``issue_key``) or report (by ``report_id``) replaces its
    earlier state; it keeps its shipment, or mail, for good. Rows may come in any order and before
    their shipment: a shipment has a row once ``shipments`` named it. A report touches the
    shipments with a document of its mail. Null keys take no part. Batches come in ascending
    order; one that died is repeated, one that was finished changes nothing. There is one writer.
    """
    table = f"{out}/table"
    if any(v.split("-", 1)[1] == f"{batch_id:010d}" for v in KT.committed_versions(spark, table)):
        return
    touched = []

    def store(df: DataFrame | None, name: str, by: str, key: str | None) -> DataFrame | None:
        if df is None:
            return None
        rows = df.where(F.col(by).isNotNull())
        rows = rows.distinct() if key is None else rows.where(F.col(key).isNotNull())
        once = (lambda r: r.distinct()) if key is None else (lambda r: _newest(r, key))
        H.append(H.bucketed(rows, [by]), f"{out}/{name}", RUN, batch_id, combine=once)
        return rows

    def taken(df: DataFrame | None, name: str, schema: T.StructType) -> DataFrame | None:
        """A batch is worked out once, however often it is looked at."""
        return None if df is None else _written(_shaped(df, schema, batch_id), f"{out}/batch/{name}")

    shipments, versions = taken(shipments, "shipments", SHIPMENT), taken(versions, "versions", VERSION)
    issues, reports = taken(issues, "issues", ISSUE), taken(reports, "reports", REPORT)
    for df, name, key in ((shipments, "shipments", None), (versions, "versions", "reg_id"), (issues, "issues", "issue_key")):
        rows = store(df, name, "shipment_key", key)
        touched += [] if rows is None else [rows.select("shipment_key")]
    store(None if versions is None else versions.select(*LINK.names), "links", "email_id", None)
    mails = store(reports, "reports", "email_id", "report_id")
    if mails is not None:
        touched.append(_of_keys(spark, f"{out}/links", LINK, mails, "email_id").select("shipment_key").where("shipment_key IS NOT NULL"))
    if not touched:
        return
    named = touched[0]
    for more in touched[1:]:
        named = named.unionByName(more)
    named = _written(named.distinct(), f"{out}/touched")
    known = _written(_of_keys(spark, f"{out}/shipments", SHIPMENT, named, "shipment_key").select("shipment_key").distinct(), f"{out}/known")
    v = _written(_newest(_of_keys(spark, f"{out}/versions", VERSION, known, "shipment_key"), "reg_id").drop("bucket", "batch_id"), f"{out}/held")
    i = _newest(_of_keys(spark, f"{out}/issues", ISSUE, known, "shipment_key"), "issue_key")
    r = _newest(_of_keys(spark, f"{out}/reports", REPORT, v.where("email_id IS NOT NULL"), "email_id"), "report_id")
    fresh = _shaped(O.overview(known, v, i, r), OVERVIEW, batch_id)
    KT.upsert_into(fresh, table, "shipment_key", ["batch_id"], f"{batch_id:010d}")


def current(spark: SparkSession, out: str) -> DataFrame:
    """The overview as the last finished batch left it: the columns of :func:`..operators.overview.overview`."""
    return KT.read_table(spark, f"{out}/table", OVERVIEW).drop("batch_id")
