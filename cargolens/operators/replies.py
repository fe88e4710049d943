"""Replies, dispatches and delivery state (RPY1-RPY18)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import text as T
from .ranking import latest


def linked_dispatches(dispatches: DataFrame, mails: DataFrame) -> DataFrame:
    """RPY1 first half: the mail of a dispatch, by id or by rewriting its stage id to a known mail."""
    known = mails.select("email_id").distinct()
    a = F.concat(F.lit("INGEST-"), F.col("stage_id"))
    b = F.when(F.startswith("stage_id", F.lit("STG-")), F.substring("stage_id", 5, 1 << 30)).otherwise(a)
    df = (dispatches.withColumn("_a", a).withColumn("_b", b)
          .join(known.select(F.col("email_id").alias("_a"), F.lit(True).alias("_ka")), "_a", "left")
          .join(known.select(F.col("email_id").alias("_b"), F.lit(True).alias("_kb")), "_b", "left"))
    linked = F.coalesce(F.nullif("email_id", F.lit("")), F.when(F.col("_ka"), F.col("_a")), F.when(F.col("_kb"), F.col("_b")))
    return df.withColumn("linked_id", linked).drop("_a", "_b", "_ka", "_kb")


def latest_dispatch(dispatches: DataFrame, mails: DataFrame) -> DataFrame:
    """RPY1: newest dispatch per mail."""
    linked = linked_dispatches(dispatches, mails).filter("linked_id IS NOT NULL").drop("email_id").withColumnRenamed("linked_id", "email_id")
    return latest(linked, ["email_id"], [F.col("dispatch_id")])


def reply_state(delivery: Column, status: Column) -> Column:
    """RPY2: state of the answer to a mail; ``delivery`` is null without a dispatch."""
    d = F.upper(delivery)
    return (
        F.when(d.isin("SENT", "SENT_SMTP"), "sent").when(d.isin("FAILED", "ERROR"), "failed").when(d == "SIMULATED", "simulated")
        .when(delivery.isNotNull(), "unknown").when(status.isin("MISMATCH", "NEEDS_REVIEW"), "awaiting").otherwise("none")
    )


def enriched_inbox(mails: DataFrame, reports: DataFrame, dispatches: DataFrame) -> DataFrame:
    """RPY3: mail, report and newest dispatch on one row."""
    r = reports.select("email_id", "category", "status", "has_defect", "review_reason", "reviewed")
    d = latest_dispatch(dispatches, mails).select("email_id", "dispatch_id", F.coalesce("delivery", F.lit("")).alias("delivery"))
    return (mails.join(r, "email_id", "left").join(d, "email_id", "left")
            .withColumn("decided_by", F.when(F.col("reviewed"), "human").otherwise("rule"))
            .withColumn("has_dispatch", F.col("dispatch_id").isNotNull())
            .withColumn("reply_state", reply_state(F.col("delivery"), F.col("status"))))


def receipt(df: DataFrame) -> DataFrame:
    """RPY4: decision and subject of the reply to a classified mail."""
    rejected = F.coalesce(F.col("status").isin("MISMATCH", "NEEDS_REVIEW"), F.lit(False))
    reason = F.coalesce("review_reason", F.lit("The SI and the B/L do not agree."))
    return (
        df.withColumn("decision", F.when(rejected, "REJECTED").otherwise("VERIFIED"))
        .withColumn("receipt_subject", F.concat(F.when(rejected, "B/L to be amended - Ref #")
                                                .otherwise("Documents verified - Ref #"), F.col("email_id")))
        .withColumn("issue", F.when(rejected, reason))
    )


def audit_data(df: DataFrame) -> DataFrame:
    """RPY5: figures of a notice, the instruction's value first. Needs si and bl field structs."""
    pick = lambda f: F.coalesce(F.col(f"si.{f}"), F.col(f"bl.{f}"))
    port = lambda f: F.coalesce(pick(f), F.lit("Counterpart Verified"))
    return df.select(
        "email_id", port("port_of_loading").alias("pol"), port("port_of_discharge").alias("pod"),
        F.coalesce(F.concat(F.format_number(pick("gross_weight_kg"), 1), F.lit(" KGS")), F.lit("Reconciled")).alias("weight"),
        F.coalesce(F.concat(pick("container_count").cast("string"), F.lit(" Unit(s)")), F.lit("Verified")).alias("containers"),
        F.array_join(F.transform("field_results", lambda r: F.concat_ws(" | ", F.initcap(F.replace(r["field"], F.lit("_"), F.lit(" "))),
                     F.coalesce(r["si_value"], F.lit("—")), F.coalesce(r["bl_value"], F.lit("—")), r["match"])), "\n").alias("ledger"))


def reply_suppression(df: DataFrame, enabled: bool = True) -> DataFrame:
    """RPY6: why no automatic reply goes out; null when one does. First rule wins."""
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(F.lit(not enabled), "Auto-reply disabled in settings").when(none("sender"), "No sender email address")
        .when((F.col("security_status") != "CLEAN") | (F.col("stage_status") == "QUARANTINED"), "Security suppression")
        .when(F.col("category") == "SPAM", "Spam suppression").when(F.col("category") != "BL_COMPARISON", "Category suppression")
        .when(F.size("attachments") == 0, "Content suppression").when(none("status"), "Pipeline suppression")
        .when(~F.col("status").isin("OK", "MISMATCH", "NEEDS_REVIEW"), "Status suppression")
    )
    return df.withColumn("suppression", reason).withColumn("should_reply", F.col("suppression").isNull())


def fingerprint(email_id: Column, recipient: Column, mailbox: Column, subject: Column, body: Column) -> Column:
    """RPY7: hash of the exact reply (values joined by a unit separator)."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(c, F.lit("")) for c in (email_id, recipient, mailbox, subject, body)]), 256)


def superseded_approvals(approvals: DataFrame) -> DataFrame:
    """RPY8 first half: an APPROVED row gives way to a newer approval of the same mail."""
    last = approvals.groupBy("email_id").agg(F.max(F.struct("created_at", "id")).alias("_last"))
    old = F.struct("created_at", "id") < F.col("_last")
    return (approvals.join(last, "email_id")
            .withColumn("status", F.when((F.col("status") == "APPROVED") & old, "SUPERSEDED").otherwise(F.col("status"))).drop("_last"))


def approval_validity(replies: DataFrame, approvals: DataFrame) -> DataFrame:
    """RPY8: may a reply go out under its approval? ``replies(approval_id, email_id, fingerprint, now)``."""
    a = superseded_approvals(approvals).select(F.col("id").alias("approval_id"), "email_id", F.col("fingerprint").alias("_f"), F.col("status").alias("_st"), F.col("created_at").alias("_at"))
    stale = F.col("_f").isNull() | (F.col("_f") != F.col("fingerprint")) | (F.col("_st") != "APPROVED")
    expired = F.col("now") - F.col("_at") > F.expr("INTERVAL 24 HOURS")
    return (replies.join(a, ["approval_id", "email_id"], "left")
            .withColumn("outcome", F.when(stale, "STALE").when(expired, "EXPIRED").otherwise("VALID")).drop("_f", "_st", "_at"))


def new_notices(notices: DataFrame, sent: DataFrame) -> DataFrame:
    """RPY9: one notice per (stage, recipient, subject), never one already sent."""
    key = ["stage_id", "recipient", "subject"]
    return latest(notices, key, [F.col("notice_id")], first=True).join(sent.select(*key).distinct(), key, "left_anti")


def is_bounce(content_type: Column, sender: Column, subject: Column) -> Column:
    """RPY10."""
    report = F.lower(content_type).rlike("^multipart/report") & F.contains(F.lower(content_type), F.lit("delivery-status"))
    return F.coalesce(report, F.lit(False)) | F.lower(sender).rlike("mailer-daemon|postmaster") | T.contains_any(F.lower(subject), rules.BOUNCE_SUBJECTS)


def status_block(block: Column) -> Column:
    """RPY11: fields of a delivery-status block; some keys keep the first value, some the last."""
    line = lambda l: F.struct(F.lower(F.trim(F.substring_index(l, ":", 1))).alias("k"), T.strip(F.regexp_extract(l, r"(?s)^[^:]*:(.*)$", 1)).alias("v"))
    rows = F.transform(F.filter(T.split_lines(block), lambda l: F.contains(l, F.lit(":"))), line)

    def fields(r):
        first = lambda k: F.get(F.filter(r, lambda x: (x["k"] == k) & (x["v"] != "")), 0)["v"]
        last = lambda k: F.try_element_at(F.filter(r, lambda x: x["k"] == k), F.lit(-1))["v"]
        address = lambda v: F.regexp_replace(T.strip(F.regexp_replace(v, r"^[^;]*;", "")), r"^<+|>+$", "")
        return F.struct(first("original-message-id").alias("original_message_id"),
                        F.coalesce(address(last("final-recipient")), address(first("original-recipient"))).alias("recipient"),
                        F.lower(last("action")).alias("action"), last("status").alias("status_code"),
                        last("diagnostic-code").alias("diagnostic"), first("original-subject").alias("original_subject"))

    return T.let(rows, fields)


def event_type(action: Column, code: Column, subject: Column) -> Column:
    """RPY12."""
    a, c = F.lower(F.coalesce(action, F.lit(""))), F.coalesce(code, F.lit(""))
    return (
        F.when(a == "delivered", "DELIVERED").when((a == "delayed") | F.startswith(c, F.lit("4.")), "DELAYED")
        .when(a.isin("failed", "failure") | F.startswith(c, F.lit("5.")), "BOUNCED")
        .when(F.lower(subject).rlike("failure|undelivered|returned mail|bounce"), "BOUNCED").otherwise("FAILED")
    )


def match_dispatch(events: DataFrame, dispatches: DataFrame) -> DataFrame:
    """RPY13: dispatch of a delivery event: message ids in order, stage reference, recipient.

    ``events(event_id, message_ids ARRAY, subjects ARRAY, recipient)``. Each way of matching
    is an equi-join with one row per key (the newest dispatch), so a recipient that
    holds a third of all dispatches adds one row and no pairs.
    """
    def newest(key):
        return dispatches.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("dispatch_id").alias("dispatch_id"))

    ids = (events.select("event_id", F.posexplode("message_ids").alias("pos", "m")).select("event_id", "pos", T.bare_message_id(F.col("m")).alias("message_id")))
    d_ids = dispatches.withColumn("message_id", T.bare_message_id(F.col("message_id"))).groupBy("message_id").agg(F.max("dispatch_id").alias("dispatch_id"))
    refs = (events.select("event_id", F.posexplode("subjects").alias("pos", "s"))
            .select("event_id", "pos", T.blank_to_null(F.regexp_extract("s", rules.STAGE_REFERENCE, 1)).alias("stage_id")))
    ways = [
        ids.filter("message_id IS NOT NULL").join(d_ids, "message_id").select("event_id", F.lit(1).alias("prio"), "pos", "dispatch_id"),
        refs.filter("stage_id IS NOT NULL").join(newest("stage_id"), "stage_id").select("event_id", F.lit(2).alias("prio"), "pos", "dispatch_id"),
        events.filter("recipient <> ''").join(newest("recipient"), "recipient").select("event_id", F.lit(3).alias("prio"), F.lit(0).alias("pos"), "dispatch_id"),
    ]
    found = ways[0].unionByName(ways[1]).unionByName(ways[2])
    best = found.groupBy("event_id").agg(F.min_by("dispatch_id", F.struct("prio", "pos")).alias("dispatch_id"), F.min("prio").alias("matched_by"))
    return events.join(best, "event_id", "left")


def distinct_events(events: DataFrame) -> DataFrame:
    """RPY14: first event per (message id, type, recipient); events without an id all stay."""
    keyed = events.withColumn("_k", F.coalesce("original_message_id", F.concat(F.lit("\u0001"), F.col("event_id").cast("string"))))
    keep = keyed.groupBy("_k", "event_type", "recipient").agg(F.min("event_id").alias("event_id")).select("event_id")
    return events.join(keep, "event_id", "left_semi")


def dispatch_state(dispatches: DataFrame, events: DataFrame) -> DataFrame:
    """RPY15: state of each dispatch from its latest event."""
    s = events.filter("dispatch_id IS NOT NULL").groupBy("dispatch_id").agg(F.max_by("event_type", F.struct("received_at", "event_id")).alias("delivery_state"))
    return dispatches.join(s, "dispatch_id", "left").withColumn("delivery_state", F.coalesce("delivery_state", F.lit("UNKNOWN")))


def dispatch_history(mails: DataFrame, dispatches: DataFrame) -> DataFrame:
    """RPY16: dispatches of a mail by id or by legacy stage key: two equi-joins, not an OR."""
    d = dispatches.select("dispatch_id", F.col("email_id").alias("_e"), "stage_id", "delivery", "created_at")
    by_id = mails.select("email_id").join(d, F.col("email_id") == F.col("_e")).drop("_e", "stage_id")
    keys = mails.select("email_id", F.explode(F.array(F.concat(F.lit("STG-"), F.col("email_id")), F.regexp_replace("email_id", "^INGEST-", ""))).alias("stage_id")).distinct()
    by_stage = keys.join(d, "stage_id").drop("_e", "stage_id")
    return by_id.unionByName(by_stage).distinct()


def clarification(df: DataFrame) -> DataFrame:
    """RPY17: which of four replies a mail gets. Needs subject, status, defect_fields, missing_documents, review_reason."""
    subj = F.coalesce(F.nullif(T.strip(F.col("subject")), F.lit("")), F.lit("your transmission"))
    docs = F.array_join("missing_documents", " and the ")
    fields = F.coalesce(F.nullif(F.array_join("defect_fields", ", "), F.lit("")), F.lit("one or more fields"))
    reason = F.replace(F.coalesce("review_reason", F.lit("the transmission could not be verified automatically")), F.lit("_"), F.lit(" "))
    miss, status = F.size("missing_documents") > 0, F.coalesce("status", F.lit(""))
    tail = (F.when(miss, F.concat(docs, F.lit(" still required"))).when(status == "MISMATCH", "Verification mismatch")
            .when(status == "OK", "Verification complete").otherwise("More detail required"))
    return (df.withColumn("decision", F.when(~miss & (status == "OK"), "VERIFIED").otherwise("REJECTED"))
            .withColumn("reply_subject", F.concat(F.lit("Re: "), subj, F.lit(" - "), tail))
            .withColumn("detail", F.when(miss, docs).when(status == "MISMATCH", fields).when(status != "OK", reason)))


def addressing(df: DataFrame, default: str = "customer@example.com") -> DataFrame:
    """RPY18: recipient of a notice and a copy to the sender when that is someone else."""
    to = F.coalesce(F.nullif("recipient", F.lit("")), T.original_sender(F.col("body")), F.nullif("sender", F.lit("")), F.lit(default))
    df = df.withColumn("notice_to", to)
    return df.withColumn("cc", F.when(F.lower("sender") != F.lower("notice_to"), F.nullif("sender", F.lit(""))))
