"""Lists, filters, counters and set operations (FLT, AGG, SRT, SET)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import text as T


def found_in(needle: str, *cols: Column) -> Column:
    """FLT2: case-insensitive substring over several columns."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))
    return F.contains(hay, F.lit(needle.strip().lower()))


def report_filter(reports: DataFrame, status: str | None = None, category: str | None = None, has_defect: bool | None = None) -> DataFrame:
    """FLT1: equality filters that are given; each reaches the scan."""
    for col, v in (("status", status), ("category", category), ("has_defect", has_defect)):
        if v is not None:
            reports = reports.filter(F.col(col) == v)
    return reports


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """SRT3: one page of an ordered list; a bounded top-k, not a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)


def with_total(page_df: DataFrame, full: DataFrame) -> DataFrame:
    """The total before paging, on every row of the page (one counted row)."""
    return page_df.crossJoin(full.agg(F.count(F.lit(1)).alias("total")))


def reply_queue(rows: DataFrame, mailbox: str | None, queue: str | None, needle: str = "") -> DataFrame:
    """FLT3."""
    if mailbox:
        rows = rows.filter(F.col("source_mailbox") == mailbox)
    if queue:
        rows = rows.filter({"reply": F.col("reply_state") == "awaiting", "failed": F.col("reply_state") == "failed",
                            "history": F.col("has_dispatch")}[queue])
    cols = [F.col(c) for c in ("email_id", "sender", "subject", "source_mailbox", "category", "status", "defect_fields")]
    return rows.filter(found_in(needle, *cols)) if needle else rows


def staging_list(staged: DataFrame, ingested: DataFrame) -> DataFrame:
    """FLT4/SET1: staged and ingested mails as one list with an origin tag and the body."""
    def shape(df, origin, status):
        return df.select(F.lit(origin).alias("origin"), "stage_id", "source_mailbox", "sender", "subject",
                         F.coalesce("body", F.lit("")).alias("body"), status.alias("status"), "created_at", "id")

    return shape(staged, "staged", F.col("status")).unionByName(shape(ingested, "ingested", F.lit("AUTO_INGESTED")))


def shipment_lookup(shipments: DataFrame, wanted: DataFrame) -> DataFrame:
    """FLT6: shipment for a human code: four exact spellings in order, then a suffix match.

    ``wanted(code)``; the exact spellings are one equi-join on candidate keys. Codes no
    candidate hits are compared with the key's last part, also by equality: of the keys with one
    tail only the smallest can answer, and it is found map-side before any row is shuffled, so a code
    of one character costs one row and not a tenth of all keys.
    """
    c = F.trim("code")
    cand = F.array(c, F.concat(F.lit("REF:"), F.upper(c)), F.upper(c), F.concat(F.lit("REF:"), c))
    exact = wanted.select("code", F.posexplode(cand).alias("prio", "shipment_key")).join(shipments.select("shipment_key"), "shipment_key")
    # One tail per length that a wanted code has; the lengths are one small row.
    lengths = wanted.agg(F.collect_set(F.length(c)).alias("lengths"))
    tails = shipments.crossJoin(F.broadcast(lengths)).select("shipment_key", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("shipment_key")).select(
        "shipment_key", F.lower(F.right("shipment_key", F.col("n"))).alias("tail")).groupBy("tail").agg(F.min("shipment_key").alias("shipment_key"))
    loose = wanted.select("code", F.lower(c).alias("tail")).join(tails, "tail").select("shipment_key", "code", F.lit(9).alias("prio"))
    best = exact.unionByName(loose).groupBy("code").agg(F.min(F.struct("prio", "shipment_key")).alias("b"))
    return wanted.join(best.select("code", F.col("b.shipment_key").alias("shipment_key")), "code", "left")


def report_lookup(reports: DataFrame, wanted: DataFrame) -> DataFrame:
    """FLT7: a report by numeric id, else by mail id: two equi-joins with a priority."""
    r = reports.select("report_id", "email_id")
    by_id = wanted.withColumn("report_id", F.col("ref").try_cast("bigint")).join(r, "report_id").select("ref", "report_id", F.lit(1).alias("p"))
    by_mail = wanted.join(r, F.col("ref") == F.col("email_id")).select("ref", "report_id", F.lit(2).alias("p"))
    best = by_id.unionByName(by_mail).groupBy("ref").agg(F.min_by("report_id", "p").alias("report_id"))
    return wanted.join(best, "ref", "left")


def origin_mailbox(email_id: Column, bundle: str, operations: str) -> Column:
    """FLT8: origin by id prefix."""
    return F.when(F.startswith(email_id, F.lit("email_")) | F.startswith(email_id, F.lit("520")), bundle).otherwise(operations)


def safe_segment(value: Column, fallback: str) -> Column:
    """FLT9: untrusted text as one path segment."""
    base = F.regexp_extract(F.regexp_replace(value, r"/+$", ""), r"([^/]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(T.blank_to_null(clean), F.lit(fallback))


def shipment_search(shipments: DataFrame, needle: str) -> DataFrame:
    """FLT11: shipments whose key, reference or latest file names contain the text."""
    cols = [F.col(c) for c in ("shipment_key", "reference_number", "si_filename", "bl_filename")]
    return shipments.filter(found_in(needle, *cols)).orderBy("shipment_key")


# -------------------------------------------------------------------- counters
def report_stats(reports: DataFrame) -> DataFrame:
    """AGG1: status, category and defect-field frequencies in long form, one pass.

    Each row explodes to its few tally keys and one combined count follows; there is
    no second scan per dimension.
    """
    keys = F.array_compact(F.concat(
        F.array(F.struct(F.lit("status").alias("dim"), F.coalesce("status", F.lit("UNKNOWN")).alias("value")),
                F.struct(F.lit("category").alias("dim"), F.coalesce("category", F.lit("UNKNOWN")).alias("value"))),
        F.transform("defect_fields", lambda f: F.struct(F.lit("defect_field").alias("dim"), f.alias("value")))))
    return reports.select(F.inline(keys)).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


def counters(df: DataFrame, **conditions: str) -> DataFrame:
    """One row of conditional counts, plus the total."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.expr(c)).alias(n) for n, c in conditions.items()])


def review_queue(reports: DataFrame) -> DataFrame:
    """AGG3: escalated mails with their bucket, its rank, label and size.

    One row per mail: buckets are not gathered into arrays, since one reason can hold
    most of the queue. Sort by (bucket_rank, reason, email_id) to read it as piles.
    """
    q = reports.filter("status = 'NEEDS_REVIEW'").withColumn("reason", F.coalesce("review_reason", F.lit("unknown")))
    # The few reasons and their sizes are one row; the mails stay where they are.
    sizes = q.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("_sizes"))
    labels = F.create_map(*[F.lit(x) for kv in rules.REVIEW_LABELS.items() for x in kv])
    pos = F.array_position(F.array(*[F.lit(r) for r in rules.REVIEW_ORDER]), F.col("reason"))
    return (q.crossJoin(F.broadcast(sizes)).withColumn("bucket_size", F.element_at("_sizes", F.col("reason"))).drop("_sizes").withColumn("bucket_rank", F.when(pos > 0, pos - 1).otherwise(99).cast("int"))
            .withColumn("label", F.coalesce(F.try_element_at(labels, F.col("reason")), "reason")))


def zero_filled(dim: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """AGG6/AGG8: count per member of a dimension, zero where there is none."""
    n = facts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return dim.select(key).distinct().join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def tally(df: DataFrame, col: str) -> DataFrame:
    """AGG8: frequency of non-null values."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def heat(status: Column, defects: Column) -> Column:
    """AGG12: tone and intensity of a row in the triage list."""
    tone = F.when(status == "MISMATCH", "bad").when(status == "NEEDS_REVIEW", "warn").when(status == "OK", "ok").otherwise("skip")
    level = (F.when(status == "MISMATCH", F.least(F.lit(0.78) + defects * 0.09, F.lit(1.0))).when(status == "NEEDS_REVIEW", 0.82)
             .when(status == "OK", 0.78).otherwise(0.45))
    return F.struct(tone.alias("tone"), F.round(level, 2).alias("intensity"))


def shares(counts: DataFrame, parts: list[str]) -> DataFrame:
    """AGG13: percentage per part and the remainder, from one row of counters."""
    pct = lambda c: F.when(F.col("total") > 0, F.floor(F.col(c) / F.col("total") * 100 + 0.5)).otherwise(0).cast("bigint")
    rest = F.col("total")
    for p in parts:
        rest = rest - F.col(p)
    return counts.select("total", *[pct(p).alias(p + "_pct") for p in parts], F.greatest(F.lit(0), rest).cast("bigint").alias("other"))


def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """AGG14: most frequent values; ties by value."""
    return tally(df, col).orderBy(F.col("n").desc(), col).limit(n)


def process_status(mails: DataFrame, reports: DataFrame) -> DataFrame:
    """AGG15: state and stage of every mail, processed or not."""
    r = reports.select("email_id", "category", "status", "review_reason", "attempts", "reviewed", F.lit(True).alias("_p"))
    df = mails.select("email_id").join(r, "email_id", "left")
    s = F.col("status")
    state = (F.when(F.col("_p").isNull(), "PENDING").when(s == "DEAD_LETTER", "DEAD").when(s == "ERROR", "FAILED").when(s == "NEEDS_REVIEW", "NEEDS_HUMAN")
             .when(s.isin("OK", "MISMATCH", "SKIPPED"), "COMPLETED").otherwise("UNKNOWN"))
    stage = (F.when(F.col("category").isNull(), "pending").when(F.col("category") != "BL_COMPARISON", "classified (non-comparison)")
             .when(s == "NEEDS_REVIEW", F.concat(F.lit("escalated: "), F.coalesce("review_reason", F.lit("needs review"))))
             .when(s == "DEAD_LETTER", F.concat(F.lit("dead letter after "), F.coalesce("attempts", F.lit(0)).cast("string"), F.lit(" attempts")))
             .when(s == "ERROR", "failed during processing").when(F.col("reviewed"), "completed (human-reviewed)").otherwise("completed"))
    return df.select("email_id", F.col("_p").isNotNull().alias("processed"), state.alias("state"), stage.alias("stage"))


# ------------------------------------------------------------------ sets, order
def arrival_order(df: DataFrame, stamp: str, position: str) -> DataFrame:
    """SRT2: undated rows first in arrival position, then by time."""
    return df.orderBy(F.col(stamp).isNotNull(), F.col(stamp), F.col(position))


def owned_split(requested: DataFrame, owned: DataFrame) -> DataFrame:
    """SET2: each distinct requested id, owned or rejected."""
    o = owned.select("email_id").distinct().withColumn("_o", F.lit(True))
    return requested.select("email_id").distinct().join(o, "email_id", "left").select("email_id", F.col("_o").isNotNull().alias("owned"))


def field_set_difference(base: Column, other: Column) -> Column:
    """SET3: fields of one run the other lost."""
    return F.array_sort(F.array_except(base, other))
