"""Mixing sources to target weights: hash-random order, prefix sums, exact budgets, epochs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BLANKS, WORD_BREAK, cut, words

WEIGHTS = (3, 1, 2)  # of the sources in code-point order, repeating
SHARE = (3, 2)  # all targets together, as a fraction of all sizes
EPOCHS = 2  # a target stops at so many times its source's size
BUCKET_ROWS = 2_000  # rows of one key range, on average
KEY_BITS = 60


def random_key(doc_id: Column, seed: str) -> Column:
    """A 60-bit number that depends on the id and the seed alone, so reruns agree."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` to rows (source, source_size): weights by code point, capped, reshared.

    Sharing by weight and resharing what exceeds a cap is water-filling. In the order of
    cap / weight a source is full when its share of what the earlier ones left reaches its
    cap; the others share the rest. There is one row per source, so these windows are small.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("_w", F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("_rank") - 1) % len(WEIGHTS))).withColumn("_cap", EPOCHS * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    filled = everything.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    total = F.sum("source_size").over(everything) * SHARE[0] / SHARE[1]
    earlier = F.coalesce(F.sum("_cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.sum("_w").over(filled.rowsBetween(0, Window.unboundedFollowing))
    full = weighed.withColumn("_total", total).withColumn("_full", (F.col("_total") - earlier) * F.col("_w") >= F.col("_cap") * later)
    left = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(left * F.col("_w") / open_weight)
    return full.withColumn("target", target.cast("double")).select("source", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` per input row.

    Each source takes its words in the order of hash-random keys: whole epochs first, then
    the documents in order until its budget (the target rounded to whole words) is met;
    the document at the cut gives the words that are still missing.

    The keys are uniform, so equal key ranges are even parts of every source, also of one
    that holds a third of all rows. Each range is sorted and summed by itself; the sums of
    the earlier ranges of its source are added as an offset. Ranges depend on the row
    alone, so a lost executor cannot change them.

    A null text has size 0 and is never taken. A null source is a source of its own and
    comes last. Rows with the same id follow each other by size. An empty table gives no rows.
    """
    sized = cut(_sized(docs, id_col, source_col, text_col, seed))
    ranges, before = _ranges(sized)
    return _placed(sized, ranges, before).select("doc_id", "source", "size", "source_size", "target", "taken")


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str, *more: Column) -> DataFrame:
    text = F.col(text_col)
    size = F.when(F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS)) == "", 0).otherwise(F.size(words(text)))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"),
                       random_key(F.col(id_col), seed).alias("_key"), *more)


def _range_of(ranges: int) -> Column:
    return F.floor(F.col("_key") / F.lit(2.0 ** KEY_BITS) * ranges)


def _ranges(sized: DataFrame) -> tuple[int, DataFrame]:
    """The number of key ranges, and per source and range what comes before it and the source's target."""
    ranges = max(1, -(-sized.count() // BUCKET_ROWS))
    per_range = sized.groupBy("source", _range_of(ranges).alias("_range")).agg(F.sum("size").alias("_sum"))
    aim = targets(per_range.groupBy("source").agg(F.sum("_sum").alias("source_size"))).withColumnRenamed("source", "_s")
    before = per_range.withColumn("_before", F.sum("_sum").over(Window.partitionBy("source").orderBy("_range")) - F.col("_sum"))
    return ranges, before.join(aim, F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_s"), F.col("_range").alias("_r"), "_before", "source_size", "target")


def _placed(sized: DataFrame, ranges: int, before: DataFrame) -> DataFrame:
    """Adds source_size, target and taken: a range's running sum after what comes before the range."""
    ranged = sized.withColumn("_range", _range_of(ranges))
    joined = ranged.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    order = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("_before") + F.sum("size").over(order) - F.col("size")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return joined.withColumn("taken", taken.cast("long"))


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix as documents with all their columns: a row per epoch of each document.

    A document at a cut is a row with its first words up to the cut; ``n_chars``, where the
    table has it, follows the text. Texts are shuffled once, to their key range.
    """
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    ranges, before = _ranges(cut(_sized(docs, "doc_id", "source", "text", seed)))
    chosen = _placed(_sized(docs, "doc_id", "source", "text", seed, row), ranges, before).where("taken > 0")
    parts = F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size"))),
                        lambda e: F.least(F.col("size"), F.col("taken") - (e - 1) * F.col("size")))
    rows = chosen.select("_row", "size", F.explode(parts).alias("_part"))
    body = F.trim(F.col("_row.text"), F.lit(BLANKS))
    first = F.array_join(F.zip_with(
        F.slice(F.split(body, WORD_BREAK), 1, F.col("_part").cast("int")),
        F.slice(F.regexp_extract_all(body, F.lit(f"({WORD_BREAK})"), 1), 1, F.col("_part").cast("int") - 1),
        lambda w, gap: F.concat(w, F.coalesce(gap, F.lit("")))), "")
    out = rows.withColumn("_text", F.when(F.col("_part") == F.col("size"), F.col("_row.text")).otherwise(first))
    fresh = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return out.select(*[fresh.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns])
