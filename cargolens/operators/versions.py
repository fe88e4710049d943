"""Document version chains (VER1-VER10)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from .ranking import latest, numbered

DOC = ["shipment_key", "doc_type"]


def content_hash(content: Column) -> Column:
    """VER1."""
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def normalised_hash(fields: Column, content: Column) -> Column:
    """VER2: hash over a ``MAP<field, normalised value>``; its bytes when it has none.

    Canonical form: ``field=value`` in field-name order, joined by ``|``.
    """
    rows = F.filter(F.array_sort(F.map_entries(fields)), lambda e: e["value"].isNotNull())
    text = F.array_join(F.transform(rows, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return F.when(F.coalesce(text, F.lit("")) != "", F.sha2(text, 256)).otherwise(F.concat(F.lit("nosig:"), content_hash(content)))


def with_duplicates(regs: DataFrame) -> DataFrame:
    """VER3: earliest registration with the same bytes or the same normalised values.

    The minimum per hash is an aggregate joined back, not a window: a document that was
    sent a million times costs one combined row per task, and the join back is an
    equi-join adaptive execution can split.
    """
    def first_with(h, out):
        return regs.groupBy(*DOC, h).agg(F.min("reg_id").alias(out))

    df = (regs.join(first_with("content_hash", "_c"), [*DOC, "content_hash"])
          .join(first_with("normalized_hash", "_n"), [*DOC, "normalized_hash"]))
    first = F.least("_c", "_n")
    dup = F.when(first < F.col("reg_id"), first)
    return (df.withColumn("duplicate_of", dup).drop("_c", "_n")
            .withColumn("document_status", F.when(F.col("duplicate_of").isNotNull(), "DUPLICATE").otherwise("ACTIVE")))


def chronology() -> list[Column]:
    """Received time, else processing time, else the start of time; then the id."""
    return [F.coalesce("received_at", "created_at", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")), F.col("reg_id")]


def slices() -> list[Column]:
    """Slices of the chronology: the hour; undated rows, all at one time, by blocks of ids."""
    undated = F.col("received_at").isNull() & F.col("created_at").isNull()
    return [F.date_trunc("hour", chronology()[0]), F.when(undated, F.floor(F.col("reg_id") / 100_000)).otherwise(0)]


def version_chain(active: DataFrame) -> DataFrame:
    """VER4-VER6, VER10: number, previous pointer and current flag of ACTIVE rows.

    Recomputed from chronology, so a late older document becomes history by itself.
    Previous and current come from equi-joins on the number, which is unique per document.
    """
    chain = numbered(active, DOC, chronology(), "version_number", slices())
    prev = chain.select(*DOC, (F.col("version_number") + 1).alias("version_number"), F.col("reg_id").alias("previous_version_id"))
    last = chain.groupBy(*DOC).agg(F.max("version_number").alias("_last"))
    return (chain.join(prev, [*DOC, "version_number"], "left").join(last, DOC)
            .withColumn("is_latest", F.col("version_number") == F.col("_last")).drop("_last"))


def document_versions(regs: DataFrame) -> DataFrame:
    """The whole register: duplicates carry their original's number and no claim to be current."""
    df = with_duplicates(regs)
    chain = version_chain(df.filter("document_status = 'ACTIVE'"))
    numbers = chain.select(F.col("reg_id").alias("duplicate_of"), "version_number")
    dups = (df.filter("document_status = 'DUPLICATE'").join(numbers, "duplicate_of", "left")
            .withColumn("previous_version_id", F.lit(None).cast("bigint")).withColumn("is_latest", F.lit(False)))
    return chain.unionByName(dups)


def latest_versions(active: DataFrame) -> DataFrame:
    """VER6 on its own: the current row per document, as one aggregate."""
    return latest(active, DOC, chronology())


def latest_pairs(active: DataFrame, value: str) -> DataFrame:
    """VER7 input: current SI and BL of a shipment on one row (pivot by aggregate)."""
    order = F.struct(*chronology())
    pick = lambda d: F.max_by(value, F.when(F.col("doc_type") == d, order)).alias(d.lower() + "_" + value)
    return active.filter(F.col("doc_type").isin("SI", "BL")).groupBy("shipment_key").agg(pick("SI"), pick("BL"))


def version_diff(chain: DataFrame, fields: list[str]) -> DataFrame:
    """VER8: each version against the one before it, one row per field."""
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    cur = chain.select(*DOC, "version_number", values.alias("cur"))
    prev = chain.select(*DOC, (F.col("version_number") + 1).alias("version_number"), values.alias("prev"))
    rows = cur.join(prev, [*DOC, "version_number"]).select(
        *DOC, "version_number", F.inline(F.arrays_zip("prev", "cur")))
    return rows.select(*DOC, "version_number", F.col("cur.field").alias("field"), F.col("prev.v").alias("from_value"),
                       F.col("cur.v").alias("to_value"), (~F.col("prev.v").eqNullSafe(F.col("cur.v"))).alias("changed"))


def fingerprint_versions(incoming: DataFrame, seen: DataFrame) -> DataFrame:
    """VER9: distinct fingerprints stored for (shipment, type), plus one when new."""
    distinct = seen.select(*DOC, "fingerprint").distinct()
    counts = distinct.groupBy(*DOC).agg(F.count(F.lit(1)).alias("_seen"))
    known = distinct.withColumn("_known", F.lit(True))
    return (incoming.join(counts, DOC, "left").join(known, [*DOC, "fingerprint"], "left")
            .withColumn("version", F.coalesce("_seen", F.lit(0)) + F.when(F.col("_known"), 0).otherwise(1))
            .drop("_seen", "_known"))


COMPARED = rules.COMPARED_FIELDS
