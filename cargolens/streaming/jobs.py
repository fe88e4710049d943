"""Structured Streaming forms of the incremental operators (STR5-STR8, STR13).

Sinks are keyed by micro-batch id, so a batch that runs again after a lost executor or
driver leaves the same rows.
"""
from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators import versions as V
from ..shared import shared_folder
from ..sources import history as H


def work_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint location."""
    return f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A sink that may not have been written yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def run_to_end(writer, checkpoint: str) -> None:
    """Drain what is available now and stop; a scheduled cluster job does the same."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def seen_once(stream: DataFrame, key: str, stamp: str, delay: str) -> DataFrame:
    """STR5: messages deduplicated by id within a watermark; state older than it is dropped."""
    return stream.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key])


def _run(checkpoint: str) -> str:
    """A name that is stable per checkpoint, so that a repeated batch is known as such."""
    return checkpoint.rstrip("/").rsplit("/", 1)[-1]


def incremental_poll(stream: DataFrame, key: str, out: str, checkpoint: str) -> None:
    """STR6: each polled mail once, skipping those the ledger already holds; :func:`polled` reads it.

    Of several rows with one key in a batch the smallest stays, so a repeated batch is the same.
    A null key is a key. The ledger is a stored history (:mod:`..sources.history`) with a
    membership filter per segment: keys that the filters deny are new, and only buckets where
    some key passed are read, to decide on these exactly. The figures of a batch go to
    ``skipped`` (:func:`poll_figures`).
    """
    rest = [c for c in stream.columns if c != key]

    def step(batch: DataFrame, batch_id: int) -> None:
        if H.is_committed(batch.sparkSession, out, _run(checkpoint), batch_id):
            return
        once = H.bucketed(batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*").select(*stream.columns), [key])
        spark, rows = batch.sparkSession, H.sizes(once)
        H.may_hold(once.select(key, "bucket"), out, key).write.mode("overwrite").parquet(f"{out}/maybe")
        maybe = spark.read.schema(T.StructType([stream.schema[key], T.StructField("bucket", T.IntegerType())])).parquet(f"{out}/maybe")
        passed = H.sizes(maybe)
        figures = [(_run(checkpoint), batch_id, sum(rows.values()), sum(passed.values()))]
        spark.createDataFrame(figures, FIGURES).coalesce(1).write.mode("overwrite").parquet(f"{out}/skipped/{_run(checkpoint)}-{batch_id}")
        known = _held(spark, out, stream.schema, key, maybe, passed)
        fresh = once if known is None else once.join(known, once[key].eqNullSafe(known["_known"]), "left_anti")
        H.append(fresh, out, _run(checkpoint), batch_id, rows, key=key)

    run_to_end(stream.writeStream.foreachBatch(step), checkpoint)


FIGURES = "run string, batch_id long, keys long, asked long"
SMALL = 200_000  # keys of a batch that may be sent to every task; more are joined by a shuffle


def _held(spark: SparkSession, out: str, schema: T.StructType, key: str, maybe: DataFrame, passed: dict[int, int]) -> DataFrame | None:
    """Which of the keys that passed a filter the ledger holds; None where none passed."""
    if not passed:
        return None
    asked = maybe.select(F.col(key).alias("_asked"))
    asked = F.broadcast(asked) if sum(passed.values()) <= SMALL else asked
    ledger = H.read(spark, out, schema, passed).select(F.col(key).alias("_known"))
    return ledger.join(asked, ledger["_known"].eqNullSafe(asked["_asked"]), "left_semi").distinct()


def poll_figures(spark: SparkSession, out: str) -> DataFrame:
    """``run, batch_id, keys, asked``: per batch of :func:`incremental_poll` its keys, and those among them that had to ask the ledger."""
    return spark.read.schema(FIGURES).parquet(f"{out}/skipped/*")


def polled(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The rows :func:`incremental_poll` has kept."""
    return H.read(spark, out, schema).drop("bucket")


HALF = T.StructType([T.StructField(n, T.StringType()) for n in ("ref", "kind", "path")])
PAIR = T.StructType([T.StructField(n, T.StringType()) for n in ("ref", "si_path", "bl_path")])


def _first_halves(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ref", "kind", "bucket").agg(F.min("path").alias("path")).select("ref", "kind", "path", "bucket")


def _first_pairs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ref", "bucket").agg(F.min("si_path").alias("si_path"), F.min("bl_path").alias("bl_path")).select("ref", "si_path", "bl_path", "bucket")


def counterpart_pass(stream: DataFrame, out: str, checkpoint: str) -> None:
    """STR7: pair a mail's half with the other half when that arrives; :func:`counterparts` reads the pairs.

    ``stream(ref, kind, email_id, path)``. Halves are a stored history, one first path per
    (reference, kind) and micro-batch after a map-side ``min``, so a hot reference adds one
    row per batch, and merging leaves one of them. A half is paired as soon as both kinds are
    known, in either order. Pairs of one reference may be written again with an earlier path;
    the first of each kind counts. A null reference pairs with nothing.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, _run(checkpoint)
        first = _first_halves(H.bucketed(batch.where("ref IS NOT NULL"), ["ref"]))
        rows = H.sizes(first)
        H.append(first, f"{out}/halves", run, batch_id, rows, _first_halves)
        known = _first_halves(H.read(spark, f"{out}/halves", HALF, rows)).join(batch.select("ref").distinct(), "ref", "left_semi")
        side = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("path"))).alias(kind.lower() + "_path")
        pairs = known.groupBy("ref", "bucket").agg(side("SI"), side("BL")).filter("si_path IS NOT NULL AND bl_path IS NOT NULL")
        H.append(pairs.select("ref", "si_path", "bl_path", "bucket"), f"{out}/pairs", run, batch_id, rows, _first_pairs)

    run_to_end(stream.writeStream.foreachBatch(step), checkpoint)


def counterparts(spark: SparkSession, out: str) -> DataFrame:
    """``ref, si_path, bl_path``: the first pair of every reference that :func:`counterpart_pass` has met."""
    return _first_pairs(H.read(spark, f"{out}/pairs", PAIR)).drop("bucket")


KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAIRED = "ref string, si_path string, bl_path string, outcome string"


class _WaitingHalves(StatefulProcessor):
    """One reference: the first path of each kind, and a timer for a half that waits alone."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("halves", "si string, bl string, expires long")

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get() if self.state.exists() else (None, None, None)
        first, expires = {"SI": held[0], "BL": held[1]}, held[2]
        latest = None
        for part in rows:  # parts of bounded size, also for a reference with very many rows
            for kind, path in part.groupby("kind")["path"].min().items():
                if kind in first and (first[kind] is None or path < first[kind]):
                    first[kind] = path
            at = part["at"].max()
            latest = at if latest is None or at > latest else latest
        whole = first["SI"] is not None and first["BL"] is not None
        if expires is not None:
            self.handle.deleteTimer(int(expires))
            expires = None
        if not whole and latest is not None:
            expires = int(latest.timestamp() * 1000) + self.wait_ms
            self.handle.registerTimer(expires)
        now = (first["SI"], first["BL"], expires)
        if now != tuple(held):
            self.state.update(now)
        if whole and (first["SI"], first["BL"]) != tuple(held[:2]):
            yield pd.DataFrame({"ref": [key[0]], "si_path": [first["SI"]], "bl_path": [first["BL"]], "outcome": ["PAIRED"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.state.get() if self.state.exists() else None
        if held is not None and (held[0] is None or held[1] is None):
            self.state.clear()
            yield pd.DataFrame({"ref": [key[0]], "si_path": [held[0]], "bl_path": [held[1]], "outcome": ["EXPIRED"]})

    def close(self) -> None:
        pass


def counterpart_state(stream: DataFrame, wait: str, delay: str) -> DataFrame:
    """STR7 with keyed state: ``ref, si_path, bl_path, outcome`` as halves arrive; no history is read.

    ``stream(ref, kind, path, at)``. The state of a reference is two paths and a timer, in a
    RocksDB store that changes with the keys a batch touches. A pair comes out when its
    second half arrives, and again with an earlier path (readers take the first of each kind).
    A half that no counterpart joined until the watermark passed its time by ``wait`` comes
    out as EXPIRED and leaves the state: :func:`all_counterparts` hands it to the batch form.
    Rows without reference, path or one of the two kinds take no part; rows that repeat
    change nothing.
    """
    millis = int(pd.Timedelta(wait).total_seconds() * 1000)
    halves = stream.where("ref IS NOT NULL AND path IS NOT NULL AND kind IN ('SI', 'BL')").select("ref", "kind", "path", "at").withWatermark("at", delay)
    return halves.groupBy("ref").transformWithStateInPandas(
        _WaitingHalves(millis), outputStructType=PAIRED, outputMode="Append", timeMode="EventTime")


def run_keyed(out: DataFrame, path: str, checkpoint: str) -> None:
    """Drains a keyed stream into a Parquet sink with the state store it needs, and leaves the session's setting as it was."""
    conf, name = out.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, KEYED_STORE)
    try:
        run_to_end(out.writeStream.format("parquet").option("path", path), checkpoint)
    finally:
        conf.set(name, before)


def all_counterparts(streamed: DataFrame) -> DataFrame:
    """``ref, si_path, bl_path`` from everything the keyed stream gave out: pairs, and halves that met only after one had expired."""
    return streamed.groupBy("ref").agg(F.min("si_path").alias("si_path"), F.min("bl_path").alias("bl_path")).where("si_path IS NOT NULL AND bl_path IS NOT NULL")


CHAIN = ["version_number", "previous_version_id", "is_latest", "document_status", "duplicate_of"]  # what a batch can change of a registration


def _newest(rows: DataFrame, key: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("batch_id")).alias("r")).select(*key, "r.*").select(*rows.columns)


def revision_chain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """STR8: revisions in any order; the chains of touched documents are renumbered.

    A late older document is inserted as history, as in the batch form. A registration that
    arrives again counts once. Registrations and their numbers are two stored histories in
    buckets of the document; a batch reads the buckets of its documents and writes only the
    registrations whose number, pointer, status or current mark it changes: the new ones and
    the tail behind them. :func:`current_chain` reads the numbers.
    """
    def once(rows: DataFrame) -> DataFrame:
        rest = [c for c in stream.columns if c != "reg_id"]
        return rows.groupBy("reg_id", "bucket").agg(F.min(F.struct(*rest)).alias("r")).select("reg_id", "bucket", "r.*").select(*stream.columns, "bucket")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, _run(checkpoint)
        if H.is_committed(spark, f"{out}/chain", run, batch_id):
            return
        marked = H.bucketed(batch, V.DOC)
        rows = H.sizes(marked)
        H.append(marked, f"{out}/regs", run, batch_id, rows, once)
        touched = batch.select(*V.DOC).distinct()
        regs = once(H.read(spark, f"{out}/regs", stream.schema, rows)).join(touched, V.DOC, "left_semi")
        chain = V.document_versions(regs.drop("bucket"))
        chain = H.bucketed(chain.select(*sorted(chain.columns), F.lit(batch_id).cast("long").alias("batch_id")), V.DOC)
        schema = T.StructType([f for f in chain.schema.fields if f.name != "bucket"])
        held = _newest(H.read(spark, f"{out}/chain", schema, rows), ["reg_id", "bucket"]).select(F.col("reg_id").alias("_reg"), *[F.col(c).alias(f"_{c}") for c in CHAIN])
        same = [F.col("reg_id") == F.col("_reg"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CHAIN]]
        H.append(chain.join(held, same, "left_anti"), f"{out}/chain", run, batch_id, H.sizes(regs), lambda r: _newest(r, ["reg_id", "bucket"]))

    run_to_end(stream.writeStream.foreachBatch(step), checkpoint)


def current_chain(spark: SparkSession, out: str) -> DataFrame:
    """Newest state of every registration written by :func:`revision_chain`."""
    return _newest(H.read(spark, f"{out}/chain"), ["reg_id", "bucket"]).drop("bucket", "batch_id")


def delivery_join(dispatches: DataFrame, events: DataFrame, within: str, delay: str) -> DataFrame:
    """STR13: dispatches with the delivery events that follow them, as both arrive.

    A left outer stream-stream join on the message id with watermarks on both sides and
    a time bound, so that state is dropped and unmatched dispatches come out once. Both bounds
    are the caller's: events later than ``delay`` behind the newest, or than ``within`` after
    their dispatch, are left to the batch form, which joins without bounds.
    """
    d = dispatches.withWatermark("created_at", delay)
    e = events.withWatermark("received_at", delay).withColumnRenamed("message_id", "event_message_id")
    cond = (F.col("message_id") == F.col("event_message_id")) & (F.col("received_at") >= F.col("created_at")) & (
        F.col("received_at") <= F.col("created_at") + F.expr(within))
    return d.join(e, cond, "left_outer")


def late_rows(stream: DataFrame, stamp: str, delay: str, out: str, checkpoint: str) -> None:
    """STR13: a ledger of the rows that a watermark of ``delay`` may have dropped, under ``out/late``.

    Kept are rows more than the delay behind the newest time seen so far, the row's own batch
    included. A watermark is behind that, however the joining stream cuts its batches, so no
    dropped row is missing; rows that were joined all the same do no harm. A batch sends one
    time to the driver.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.agg(F.max(stamp).alias("newest")).write.mode("overwrite").parquet(f"{out}/newest/batch_id={batch_id}")
        newest = _read(batch.sparkSession, f"{out}/newest", "newest timestamp, batch_id int").where(F.col("batch_id") <= batch_id).agg(F.max("newest").alias("n")).first()["n"]
        behind = batch.where(F.col(stamp) < F.lit(newest) - F.expr(f"INTERVAL {delay}")) if newest is not None else batch.limit(0)
        behind.write.mode("overwrite").parquet(f"{out}/late/batch_id={batch_id}")

    run_to_end(stream.writeStream.foreachBatch(step), checkpoint)


def read_late(spark: SparkSession, out: str, schema) -> DataFrame:
    return _read(spark, f"{out}/late", schema)


def completed_deliveries(streamed: DataFrame, late_dispatches: DataFrame, late_events: DataFrame, dispatches: DataFrame, events: DataFrame, within: str) -> DataFrame:
    """STR13: ``dispatch_id, notice_id`` of the stream, completed by what arrived too late for it.

    Late events meet all dispatches and late dispatches all events by message id, so the cost
    follows the late rows; a dispatch without any notice comes once with a null. Equals the
    batch join on every order of arrival, also where the stream had given a dispatch out as
    unmatched before its notice came.
    """
    def met(d: DataFrame, e: DataFrame) -> DataFrame:
        e = e.withColumnRenamed("message_id", "_message")
        cond = (F.col("message_id") == F.col("_message")) & (F.col("received_at") >= F.col("created_at")) & (F.col("received_at") <= F.col("created_at") + F.expr(within))
        return d.join(e, cond).select("dispatch_id", "notice_id")

    pairs = streamed.where("notice_id IS NOT NULL").select("dispatch_id", "notice_id").unionByName(met(dispatches, late_events)).unionByName(met(late_dispatches, events)).distinct()
    alone = dispatches.select("dispatch_id").distinct().join(pairs, "dispatch_id", "left_anti").withColumn("notice_id", F.lit(None).cast(pairs.schema["notice_id"].dataType))
    return pairs.unionByName(alone)
