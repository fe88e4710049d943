"""Issues, resolutions and human reviews (ISS1-ISS11)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from . import compare as K
from .ranking import latest

LIVE = ["OPEN", "SUGGESTED", "PENDING_APPROVAL"]


def issues_of(reports: DataFrame) -> DataFrame:
    """ISS1/ISS3: one suggested issue with its resolution per differing field."""
    rows = reports.select("report_id", "email_id", "shipment_key", F.inline("field_results")).filter("match = 'DIFF'")
    diff = K.difference(F.col("field"), F.col("si_value"), F.col("bl_value"))
    return (
        rows.withColumn("issue_key", F.concat_ws(":", F.col("report_id").cast("string"), F.col("field")))
        .withColumn("difference", diff).withColumn("explanation", K.explanation(F.col("field"), F.col("difference")))
        .withColumn("suggested_value", F.col("si_value"))
        .withColumn("suggested_action", F.concat(F.lit("UPDATE_BL_"), F.upper("field")))
        .withColumn("severity", K.severity(F.col("field"))).withColumn("status", F.lit("SUGGESTED"))
        .withColumnRenamed("field", "field_name").drop("match")
    )


def supersede(stored: DataFrame, current: DataFrame) -> DataFrame:
    """ISS2: live issues whose field no longer differs are superseded."""
    still = current.select("shipment_key", "field_name").distinct().withColumn("_still", F.lit(True))
    return (stored.join(still, ["shipment_key", "field_name"], "left")
            .withColumn("status", F.when(F.col("status").isin(LIVE) & F.col("_still").isNull(), "SUPERSEDED")
                        .otherwise(F.col("status"))).drop("_still"))


def fold_decisions(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """ISS4: the latest approve or reject decision of an issue becomes its status."""
    last = latest(decisions.select("issue_key", "decision", "decided_at", "decision_id"), ["issue_key"],
                  [F.col("decided_at"), F.col("decision_id")])
    return (issues.join(last.select("issue_key", "decision", "decided_at"), "issue_key", "left")
            .withColumn("status", F.coalesce("decision", "status")).drop("decision"))


def resolution_status(shipments: DataFrame, issues: DataFrame) -> DataFrame:
    """ISS5: issue counters and resolution status per shipment."""
    is_in = lambda *s: F.count_if(F.col("status").isin(*s))
    c = issues.filter("status <> 'SUPERSEDED'").groupBy("shipment_key").agg(
        F.count(F.lit(1)).alias("total_issues"), is_in("APPROVED").alias("resolved"),
        is_in("SUGGESTED", "PENDING_APPROVAL").alias("pending_approval"), is_in("REJECTED").alias("rejected"), is_in("OPEN").alias("open"))
    df = shipments.select("shipment_key").join(c, "shipment_key", "left").na.fill(0)
    return df.withColumn("status", F.when(F.col("total_issues") == 0, "VERIFIED")
                         .when(F.col("resolved") == F.col("total_issues"), "RESOLVED")
                         .when(F.col("pending_approval") > 0, "PENDING_APPROVAL").otherwise("NEEDS_REVIEW"))


def approve_all(issues: DataFrame) -> DataFrame:
    """ISS6: every live issue of a shipment is approved in one go."""
    return issues.withColumn("status", F.when(F.col("status").isin(LIVE), "APPROVED").otherwise(F.col("status")))


def corrected_draft(bl: DataFrame, approved: DataFrame) -> DataFrame:
    """SNK4: approved values over the latest BL fields, rendered as text.

    ``approved(shipment_key, reg_id, field_name, suggested_value)``; at most seven fields per shipment.
    """
    pairs = approved.groupBy("shipment_key").agg(*[
        F.max_by("suggested_value", F.when(F.col("field_name") == f, F.col("reg_id"))).alias("fix_" + f) for f in rules.COMPARED_FIELDS])
    df = bl.join(pairs, "shipment_key")
    lines = [F.concat(F.lit(f + ": "), F.coalesce("fix_" + f, F.col(f).cast("string"), F.lit(""))) for f in rules.COMPARED_FIELDS]
    text = F.concat_ws("\n", F.lit("GENERATED CORRECTED BL DRAFT"), F.concat(F.lit("Shipment ID: "), F.col("shipment_key")),
                       F.concat(F.lit("Source BL version: "), F.col("version_id").cast("string")),
                       F.lit("Values approved by a reviewer replace those of the draft."), F.lit(""), *lines)
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract("filename", r"([^/]*)$", 1), r"\.[^.]*$", ""), " ", "_")
    name = F.concat(stem, F.lit("_Corrected_v"), F.col("version_number").cast("string"), F.lit(".txt"))
    return df.select("shipment_key", name.alias("draft_name"), text.alias("draft"))


def apply_reviews(reports: DataFrame, reviews: DataFrame) -> DataFrame:
    """ISS7: the latest human decision per mail over its report.

    CORRECT overlays BL fields and compares again; CONFIRM and REJECT only mark the row.
    ``reports`` carries si_fields, bl_fields (structs) and the verdict columns.
    """
    last = latest(reviews.select("email_id", "review_id", "decision", "corrected_fields", "corrected_category"), ["email_id"], [F.col("review_id")])
    df = reports.join(last.drop("review_id"), "email_id", "left")
    fixed = F.struct(*[
        F.coalesce(F.try_element_at("corrected_fields", F.lit(f)).try_cast({"container_count": "bigint", "gross_weight_kg": "double"}.get(f, "string")),
                   F.col("bl_fields")[f]).alias(f) for f in rules.ALL_FIELDS])
    redo = (F.col("decision") == "CORRECT") & (F.size(F.map_keys("corrected_fields")) > 0)
    return (
        df.withColumn("reviewed", F.col("decision").isNotNull())
        .withColumn("category", F.coalesce(F.when(F.col("decision") == "CORRECT", F.col("corrected_category")), "category"))
        .withColumn("bl_fields", F.when(redo, fixed).otherwise(F.col("bl_fields"))).withColumn("redo", F.coalesce(redo, F.lit(False)))
    )


def override(reports: DataFrame, overrides: DataFrame) -> DataFrame:
    """ISS8: the latest manual status wins; fields and reason follow it."""
    last = latest(overrides, ["email_id"], [F.col("review_id")]).select("email_id", "new_status", "new_fields")
    df = reports.join(last, "email_id", "left")
    o = F.col("new_status")
    none = F.array().cast("array<string>")
    return (
        df.withColumn("status", F.coalesce(o, "status"))
        .withColumn("has_defect", F.when(o.isNotNull(), o == "MISMATCH").otherwise(F.col("has_defect")))
        .withColumn("defect_fields", F.when(o == "MISMATCH", F.coalesce("new_fields", "defect_fields")).when(o.isNotNull(), none).otherwise(F.col("defect_fields")))
        .withColumn("review_reason", F.when(o.isNotNull() & (o != "NEEDS_REVIEW"), F.lit(None)).otherwise(F.col("review_reason")))
        .drop("new_status", "new_fields")
    )


def label(field: Column) -> Column:
    return F.replace(F.replace(field, F.lit("_kg"), F.lit("")), F.lit("_"), F.lit(" "))


def correction_mail(issues: DataFrame) -> DataFrame:
    """ISS10: correction mail per report; a report has at most seven issues, so the list is bounded."""
    shown = lambda c: F.coalesce(c, F.lit("not provided"))
    block = F.concat_ws("\n", F.concat(label(F.col("field_name")), F.lit(":")), F.concat(F.lit("SI: "), shown(F.col("si_value"))),
                        F.concat(F.lit("BL: "), shown(F.col("bl_value"))), F.lit(""))
    order = F.array_position(F.array(*[F.lit(f) for f in rules.COMPARED_FIELDS]), F.col("field_name"))
    g = issues.groupBy("report_id", "shipment_key").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), block.alias("b")))).alias("blocks"))
    ref = F.substring_index("shipment_key", ":", -1)
    body = F.concat_ws("\n", F.lit("Hello,"), F.lit(""),
                       F.lit("The shipping instruction and the bill of lading draft differ in these fields:"), F.lit(""),
                       F.concat(F.lit("Shipment: "), ref), F.lit(""), F.array_join(F.transform("blocks", lambda x: x["b"]), "\n"),
                       F.lit("Please tell us which value is right. Nothing is changed until then."), F.lit(""), F.lit("Regards,"))
    return g.select("report_id", "shipment_key", F.concat(F.lit("BL draft differs from SI, shipment "), ref).alias("subject"), body.alias("body"))


def assistance(issues: DataFrame) -> DataFrame:
    """ISS11: rule explanation, suggestion and confidence of one mismatch."""
    shown = lambda c: F.coalesce(c, F.lit("not provided"))
    si, bl, lab = shown(F.col("si_value")), shown(F.col("bl_value")), label(F.col("field_name"))
    gap = F.coalesce(F.concat(F.lit(" They differ by "), F.col("difference"), F.lit(".")), F.lit(""))
    return issues.select(
        "issue_key",
        F.concat(F.lit("The "), lab, F.lit(": the BL states "), bl, F.lit(", the SI "), si, F.lit("."), gap).alias("explanation"),
        F.concat(F.lit("Review the "), lab, F.lit(". Should the SI be right, the BL draft becomes "), si, F.lit(".")).alias("suggestion"),
        F.when(F.col("si_value").isNotNull() & F.col("bl_value").isNotNull(), "HIGH").otherwise("MEDIUM").alias("confidence"))
