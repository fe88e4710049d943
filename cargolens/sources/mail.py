"""Mail sources and sinks (SRC1-SRC6, SRC14-SRC16, SNK1-SNK2)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T

RAW_MAIL = ("email_id string, id string, message_id string, sender string, `from` string, email string, subject string, body string, text string, "
            "content string, attachments string, files string, received_at string, timestamp string, date string")


def read_mail_folder(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: one JSON object per ``email_*.json`` file, with the file stem."""
    df = spark.read.schema(RAW_MAIL).option("multiLine", True).option("pathGlobFilter", "email_*.json").json(path)
    return df.select("*", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("stem"))


def normalise_mail(raw: DataFrame) -> DataFrame:
    """SRC2: alternate key names coalesced; attachments as an array in any spelling."""
    def first(*cols):
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])

    listed = first("attachments", "files")
    att = F.coalesce(F.from_json(listed, "array<string>"), F.array(listed))
    return raw.select(
        first("email_id", "id", "message_id", "stem").alias("email_id"), first("sender", "from", "email").alias("sender"), "subject",
        first("body", "text", "content").alias("body"),
        F.when(listed.isNull(), F.array().cast("array<string>")).when(F.startswith(listed, F.lit("[")), att).otherwise(F.array(listed)).alias("attachments"),
        T.naive_utc(first("received_at", "timestamp", "date")).alias("received_at"))


def insert_new(stored: DataFrame, incoming: DataFrame, key: str = "email_id") -> DataFrame:
    """SRC3: incoming rows whose id is not stored yet."""
    return incoming.dropDuplicates([key]).join(stored.select(key).distinct(), key, "left_anti")


def read_attachments(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """SRC4: attachment bytes with ``refused``, null or the reason a file's content is not read.

    A size bound is checked on metadata; a file over it keeps its row, without content.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if max_bytes is None:
        return df.withColumn("refused", F.lit(None).cast("string"))
    small = df.filter(F.col("length") <= max_bytes).withColumn("refused", F.lit(None).cast("string"))
    large = df.filter(F.col("length") > max_bytes).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"), F.lit("larger than the limit").alias("refused"))
    return small.unionByName(large)


def inbox(corpus: DataFrame, stored: DataFrame, include_ingested: bool = True) -> DataFrame:
    """SRC5: corpus rows and the stored rows the corpus lacks."""
    return corpus.unionByName(stored.join(corpus.select("email_id"), "email_id", "left_anti")) if include_ingested else corpus


def lookup(wanted: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """SRC6: a mail by id from the first store, else from the second."""
    a = first.select("email_id", F.struct("subject", "sender").alias("a"))
    b = second.select("email_id", F.struct("subject", "sender").alias("b"))
    j = wanted.join(a, "email_id", "left").join(b, "email_id", "left")
    return j.select("email_id", F.coalesce("a", "b").alias("m"), F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").alias("found_in")).select("email_id", "m.*", "found_in")


def html_to_text(html: Column) -> Column:
    """SRC14: scripts and styles dropped, tags to blanks, white space squeezed."""
    v = F.regexp_replace(html, r"(?is)<(script|style).*?>.*?</\1>", " ")
    return T.squeeze(F.regexp_replace(v, r"(?s)<[^>]+>", " "))


def html_to_lines(html: Column) -> Column:
    """SRC14, block-aware: table cells become ``label | value``, blocks become lines."""
    v = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    v = F.regexp_replace(F.regexp_replace(v, r"(?i)</t[dh]>", " | "), r"(?i)</?(?:br|p|div|tr|li|h[1-6])\b[^>]*>", "\n")
    v = F.regexp_replace(v, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        v = F.replace(v, F.lit(entity), F.lit(char))
    lines = F.transform(T.split_lines(v), lambda l: F.regexp_replace(F.regexp_replace(l, r"[ \t\xa0]{2,}", " "), r"^[ |]+|[ |]+$", ""))
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")


def nested_documents(nested: DataFrame) -> DataFrame:
    """SRC15: headers and body of a nested mail as one fallback document."""
    stem = F.regexp_replace(F.regexp_extract("filename", r"([^/\\]*)$", 1), r"(?i)\.(?:eml|msg)$", "")
    text = T.strip(F.concat_ws("\n", F.concat(F.lit("From: "), F.col("sender")), F.concat(F.lit("Subject: "), F.col("subject")), F.col("body")))
    return nested.select("email_id", F.concat(stem, F.lit(".frombody.txt")).alias("path"), text.alias("text")).filter("text <> ''")


def unbundle(mails: DataFrame) -> DataFrame:
    """SRC16: one child per nested mail of a batch forward.

    ``nested ARRAY<STRUCT<sender,subject,date,body>>``, ``direct_documents BOOLEAN``.
    """
    n = F.size("nested")
    batch = mails.filter((n > 1) | ((n == 1) & ~F.col("direct_documents")))
    rows = batch.select("email_id", F.col("sender").alias("wrapper"), n.alias("total"), F.posexplode("nested").alias("i", "c"))
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label + ": "), c))
    idx = F.col("i") + 1
    head = F.concat(F.lit("---------- Forwarded message (Batch "), idx.cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(") ---------"))
    by = F.when(F.col("wrapper") != "", F.concat(F.lit("Forwarded-By: "), F.col("wrapper"), F.lit("\n")))
    body = F.concat_ws("\n", head, line("From", F.col("c.sender")), line("Subject", F.col("c.subject")), line("Date", F.col("c.date")), by)
    return rows.select("email_id", idx.alias("idx"), "total", F.concat(body, F.lit("\n"), F.coalesce("c.body", F.lit(""))).alias("body"))


def contract_status(status: Column, category: Column) -> Column:
    """SNK2: internal status as the submission contract names it."""
    s = F.upper(F.coalesce(status, F.lit("")))
    return (F.when(s == "ERROR", "NEEDS_REVIEW").when(s.isin("OK", "MISMATCH", "NEEDS_REVIEW"), s)
            .when(category == "BL_COMPARISON", "NEEDS_REVIEW").otherwise("OK"))


def submission(sample: DataFrame, reports: DataFrame) -> DataFrame:
    """SNK1: one entry per requested mail; unprocessed mails are GENERAL/OK. Write with ``.write.json``."""
    r = reports.select("email_id", "category", "status", "review_reason", "has_defect", "defect_fields")
    return sample.select("email_id").join(r, "email_id", "left").select(
        "email_id", F.coalesce("category", F.lit("GENERAL")).alias("category"), contract_status(F.col("status"), F.col("category")).alias("status"),
        "review_reason", F.coalesce("has_defect", F.lit(False)).alias("has_defect"), F.coalesce("defect_fields", F.array().cast("array<string>")).alias("defect_fields"))
