"""Process-once, retry and incremental operators, batch form (STR1-STR5, STR9-STR12)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources import history as H
from .ranking import latest


def mail_fingerprint(subject: Column, body: Column, names: Column, hashes: Column) -> Column:
    """STR1: hash over subject, body and each attachment's name and content hash, NUL-separated."""
    nul = "\u0000"
    parts = F.flatten(F.zip_with(names, hashes, lambda n, c: F.array(F.coalesce(n, F.lit("")), F.coalesce(c, F.lit("")))))
    return F.sha2(F.array_join(F.concat(F.array(F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))), parts), nul), 256)


def identity(email_id: Column, message_id: Column, fingerprint: Column) -> Column:
    """STR2: resolved mail id and cache key."""
    e, m = F.nullif(email_id, F.lit("")), F.nullif(message_id, F.lit(""))
    made = F.concat(F.lit("MSG_"), F.upper(fingerprint))
    return F.struct(F.coalesce(e, m, made).alias("resolved_id"), F.coalesce(m, e, made).alias("cache_key"))


def probe(requests: DataFrame, results: DataFrame) -> DataFrame:
    """STR3: stored result of a request: cache key, message id, mail id; the thread only
    when the request names no message at all. ``requests(req_id, cache_key, message_id, email_id, thread_id)``.

    Each key is an equi-join against one stored row per key value.
    """
    def way(prio, col, newest=False, cond=None):
        pick = F.max("result_id") if newest else F.min("result_id")
        keyed = results.filter(F.col(col).isNotNull()).groupBy(col).agg(pick.alias("result_id"))
        r = requests.filter(F.col(col).isNotNull() & (F.col(col) != ""))
        return (r if cond is None else r.filter(cond)).select("req_id", col).join(keyed, col).select("req_id", F.lit(prio).alias("prio"), "result_id")

    bare = F.coalesce("email_id", F.lit("")).eqNullSafe("") & F.coalesce("message_id", F.lit("")).eqNullSafe("")
    hits = way(1, "cache_key").unionByName(way(2, "message_id")).unionByName(way(3, "email_id")).unionByName(way(4, "thread_id", True, bare))
    best = hits.groupBy("req_id").agg(F.min_by("result_id", "prio").alias("result_id"), F.min("prio").alias("found_by"))
    return requests.join(best, "req_id", "left")


def reuse(probed: DataFrame, results: DataFrame, force: Column | None = None) -> DataFrame:
    """STR4: REUSE on an equal content hash, else RUN."""
    r = results.select("result_id", F.col("content_hash").alias("_h"))
    same = F.col("_h").eqNullSafe(F.col("content_hash"))
    go = same & ~(force if force is not None else F.lit(False))
    return probed.join(r, "result_id", "left").withColumn("decision", F.when(go, "REUSE").otherwise("RUN")).drop("_h")


def unseen(incoming: DataFrame, seen: DataFrame) -> DataFrame:
    """STR5: messages whose id and subject the ledger does not hold."""
    out = incoming.join(seen.select("message_key").distinct(), "message_key", "left_anti")
    subjects = seen.select(F.lower(F.trim("subject")).alias("_s")).distinct()
    return out.withColumn("_s", F.lower(F.trim("subject"))).join(subjects, "_s", "left_anti").drop("_s")


def unseen_by_filter(incoming: DataFrame, seen: DataFrame, folder: str, key: str = "message_key") -> DataFrame:
    """STR5, SRC3: rows whose key the ledger does not hold, by a membership filter first.

    The ledger's keys are stored under ``folder`` with a filter. Only keys that pass it meet the
    ledger: a semi-join narrows the ledger to these, and what it holds of them is taken out. An
    exact result; a null key is a key, rows that repeat stay.
    """
    spark = incoming.sparkSession
    H.append(H.bucketed(seen.select(key).distinct(), [key]), folder, "ledger", 0, key=key)
    asked = H.may_hold(H.bucketed(incoming.select(key).distinct(), [key]), folder, key).select(F.col(key).alias("_asked"))
    ledger = H.read(spark, folder, incoming.select(key).schema).select(F.col(key).alias("_known"))
    held = ledger.join(asked, ledger["_known"].eqNullSafe(asked["_asked"]), "left_semi").distinct()
    return incoming.join(held, incoming[key].eqNullSafe(held["_known"]), "left_anti")


def retry_plan(reports: DataFrame, cap: int = 3, statuses: tuple[str, ...] = ("ERROR", "NEEDS_REVIEW")) -> DataFrame:
    """STR9: what a retry does to each failed report."""
    dead = (F.col("status") == "ERROR") & (F.coalesce("attempts", F.lit(0)) >= max(1, cap))
    return reports.filter(F.col("status").isin(list(statuses))).withColumn("outcome", F.when(dead, "DEAD_LETTER").otherwise("RETRY"))


def dead_letters(reports: DataFrame) -> DataFrame:
    """STR10: retired rows, newest failure first."""
    return reports.filter("status = 'DEAD_LETTER'").orderBy(F.col("updated_at").desc(), F.col("report_id").desc())


def requeue(wanted: DataFrame, reports: DataFrame) -> DataFrame:
    """STR11: outcome of asking for a retired mail to run again."""
    r = reports.select("email_id", F.col("status").alias("_st"))
    out = F.when(F.col("_st").isNull(), "NOT_FOUND").when(F.col("_st") != "DEAD_LETTER", "NOT_DEAD_LETTER").otherwise("REQUEUED")
    return wanted.join(r, "email_id", "left").withColumn("outcome", out).drop("_st")


def attempts(runs: DataFrame) -> DataFrame:
    """STR12: runs per mail."""
    return runs.groupBy("email_id").agg(F.count(F.lit(1)).alias("attempts"))


def upsert(stored: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """SNK3: newest row per key over stored and fresh rows; every column comes from it."""
    return latest(stored.unionByName(fresh), [key], [F.col(order)])
