"""Evaluation against gold labels and robustness studies (EVL1-EVL14)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


def predictions(gold: DataFrame, predicted: DataFrame, key: str, default: str) -> DataFrame:
    """Gold rows with their prediction; rows nobody predicted get the default class."""
    return gold.join(predicted, key, "left").withColumn("predicted", F.coalesce("predicted", F.lit(default)))


def confusion(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """EVL1: gold by predicted, one column per class."""
    return pairs.groupBy("gold").agg(*[F.count_if(F.col("predicted") == c).alias(c) for c in classes])


def class_scores(pairs: DataFrame) -> DataFrame:
    """EVL2: precision, recall and F1 per class, from one count per (gold, predicted)."""
    cell = pairs.groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))
    rows = cell.select(F.inline(F.array(
        F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("g"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp")))))
    s = rows.groupBy("label").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("p")), ratio(F.col("tp"), F.col("g"))
    s = s.withColumn("precision", p).withColumn("recall", r)
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def misclassified(pairs: DataFrame) -> DataFrame:
    """EVL3."""
    return pairs.filter("gold <> predicted").groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "gold", "predicted")


def caught(rows: DataFrame) -> DataFrame:
    """EVL4: per gold defect mail: routed, flagged, exact field set."""
    same = F.array_sort("defect_fields") == F.array_sort("gold_fields")
    d = rows.filter("gold_category = 'BL_COMPARISON' AND gold_defect")
    return (d.withColumn("routed", F.col("category") == "BL_COMPARISON").withColumn("flagged", F.col("has_defect")).withColumn("exact", same)
            .withColumn("caught", F.col("routed") & F.col("flagged") & F.col("exact")))


def field_scores(rows: DataFrame) -> DataFrame:
    """EVL5: micro precision, recall and F1 over field sets."""
    return rows.agg(*_field_counts()).select(*_field_ratios())


def _field_counts() -> list[Column]:
    return [F.sum(F.size(F.array_intersect("defect_fields", "gold_fields"))).alias("tp"), F.sum(F.size("defect_fields")).alias("p"), F.sum(F.size("gold_fields")).alias("g")]


def _field_ratios() -> list[Column]:
    p = F.coalesce(F.col("tp") / F.nullif("p", F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("tp") / F.nullif("g", F.lit(0)), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1")]


def verdict_scores(rows: DataFrame) -> DataFrame:
    """Parts of EVL6 that need the verdicts: end-to-end share and defect F1, from one aggregate."""
    wanted = (F.col("gold_category") == "BL_COMPARISON") & F.col("gold_defect")
    hit = (F.col("category") == "BL_COMPARISON") & F.col("has_defect") & (F.array_sort("defect_fields") == F.array_sort("gold_fields"))
    e2e = F.avg(F.when(wanted, hit.cast("int"))).alias("e2e")
    return rows.agg(e2e, *_field_counts()).select("e2e", *_field_ratios()).select("e2e", F.col("f1").alias("defect_f1"))


def final_score(verdicts: DataFrame, macro: DataFrame) -> DataFrame:
    """EVL6: 0.5 end-to-end + 0.3 macro F1 + 0.2 defect F1, from two one-row frames."""
    j = verdicts.crossJoin(macro)
    return j.withColumn("score", 0.5 * F.col("e2e") + 0.3 * F.col("macro_f1") + 0.2 * F.col("defect_f1"))


def escalations(rows: DataFrame) -> DataFrame:
    """EVL7: escalated per gold reason, caught and total."""
    return (rows.filter("gold_status = 'NEEDS_REVIEW'").groupBy("gold_reason")
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "NEEDS_REVIEW").alias("caught")))


def false_escalations(rows: DataFrame) -> DataFrame:
    """EVL8: our escalations gold does not have, by own reason and gold status."""
    r = rows.filter("status = 'NEEDS_REVIEW' AND gold_status <> 'NEEDS_REVIEW'")
    return r.groupBy(F.coalesce("review_reason", F.lit("(none)")).alias("reason"), "gold_status").agg(F.count(F.lit(1)).alias("n"))


def code_study(pairs: DataFrame) -> DataFrame:
    """EVL9: port code presence by side, with what the strict and the name-only rule say.

    ``pairs(si_name, si_code, bl_name, bl_code, matched)``.
    """
    lenient = F.col("si_name") == F.col("bl_name")
    return (pairs.groupBy(F.col("si_code").isNotNull().alias("si_has"), F.col("bl_code").isNotNull().alias("bl_has"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("matched")).alias("strict_mismatch"), F.count_if(~lenient).alias("lenient_mismatch"),
                 F.count_if(~F.col("matched") & lenient).alias("lost"), F.count_if(F.col("matched") & ~lenient).alias("gained")))


PERTURBATIONS = ["whitespace", "nbsp", "blank_lines", "uppercase", "collapse_lines", "label_synonyms"]
# Label spellings that mean the same.
LABEL_SYNONYMS = {
    "port of loading": ["load port", "place of receipt", "pol"],
    "port of discharge": ["discharge port", "destination port", "pod"],
    "gross weight": ["gross wt", "gross mass", "total gross weight"],
    "container count": ["no. of containers", "total containers", "ctnr"],
    "shipper": ["exporter", "principal"],
    "consignee": ["buyer", "receiver"],
    "notify party": ["notify address", "notified party"],
}


def _hash(*parts: Column) -> Column:
    """A 32-bit number from an MD5 of the parts, which other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def _swapped(other: str, canon: str, take: Column):
    """A text with its first such spelling replaced where asked for. The pattern stays the same from row to row, so it is compiled once; it takes the rest of the text along, so it is found once."""
    return lambda x: F.when(take, F.regexp_replace(x, rf"(?is)\Q{other}\E(?=\s*[:：|])(.*+)", canon + "$1")).otherwise(x)


def perturb(text: Column, key: Column, kind: str) -> Column:
    """EVL10: a change that keeps the meaning. Chance is replaced by a hash of key and line."""
    lines = T.split_lines(text)
    draw = lambda i, n: _hash(key, i.cast("string"), F.lit(str(n))) % 100
    if kind == "whitespace":
        def spaced(l, i):
            body = F.when(draw(i, 1) < 70, F.regexp_replace(l, r"[ \t]+", " ")).otherwise(F.regexp_replace(l, r"[ \t]+", "  "))
            return F.when(draw(i, 2) < 15, F.concat(F.lit("\t"), body)).otherwise(body)
        return F.array_join(F.transform(lines, spaced), "\n")
    if kind == "nbsp":
        return F.array_join(F.transform(lines, lambda l, i: F.when(draw(i, 3) < 30, F.translate(l, " ", chr(0xA0))).otherwise(l)), "\n")
    if kind == "blank_lines":
        return F.array_join(lines, "\n\n")
    if kind == "uppercase":
        return F.upper(text)
    if kind == "collapse_lines":
        return F.array_join(lines, " ")
    if kind == "label_synonyms":
        out = text
        for canon, others in LABEL_SYNONYMS.items():
            for other in others:
                out = T.let(out, _swapped(other, canon, _hash(key, F.lit(other)) % 2 == 0))
        return out
    raise ValueError(kind)


def perturbed(docs: DataFrame, kinds: list[str] = PERTURBATIONS) -> DataFrame:
    """EVL10: the base text and its six variants as rows, from one scan; a row works out its own variant only."""
    which = F.col("perturbation")
    text = F.when(which == "base", F.col("text"))
    for k in kinds:
        text = text.when(which == k, perturb(F.col("text"), F.col("path"), k))
    rows = docs.select("email_id", "doc_type", "path", "text", F.explode(F.array(F.lit("base"), *[F.lit(k) for k in kinds])).alias("perturbation"))
    return rows.select("email_id", "doc_type", "path", "perturbation", text.alias("text"))


def stability(results: DataFrame) -> DataFrame:
    """EVL11: verdict changes and lost fields per perturbation.

    ``results(email_id, perturbation, defect_fields, missing)``.
    """
    base = results.filter("perturbation = 'base'").select("email_id", F.col("defect_fields").alias("_d"), F.col("missing").alias("_m"))
    r = results.filter("perturbation <> 'base'").join(base, "email_id")
    changed = F.array_sort("defect_fields") != F.array_sort("_d")
    return r.groupBy("perturbation").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(changed).alias("verdict_changes"),
                                         F.sum(F.size(F.array_except("missing", "_m"))).alias("fields_lost"))


def false_mismatches(rows: DataFrame) -> DataFrame:
    """EVL12: mismatching fields of mails gold calls OK, with both values."""
    r = rows.filter("status = 'MISMATCH' AND gold_status = 'OK'").select("email_id", F.inline("field_results"))
    return r.filter("match = 'DIFF'").drop("match")


def coverage(mails: DataFrame, reports: DataFrame) -> DataFrame:
    """EVL13: mails, reports and mails without a report."""
    m = mails.agg(F.count(F.lit(1)).alias("mails"))
    r = reports.agg(F.count(F.lit(1)).alias("reports"))
    g = mails.join(reports.select("email_id").distinct(), "email_id", "left_anti").agg(F.count(F.lit(1)).alias("uncovered"))
    return m.crossJoin(r).crossJoin(g).withColumn("passed", (F.col("uncovered") == 0) & (F.col("reports") > 0))


def expectations(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """EVL14: expected against actual shipment state, one boolean per check."""
    j = expected.join(actual, "shipment_key", "left")
    ok = lambda c: F.coalesce(c, F.lit(False))
    return j.select("shipment_key", ok(F.col("status") == F.col("want_status")).alias("status_ok"),
                    ok(F.array_sort("missing_documents") == F.array_sort("want_missing")).alias("missing_ok"),
                    ok(F.col("si_versions") >= F.col("want_si_versions")).alias("versions_ok"))
