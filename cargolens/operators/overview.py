"""Shipment overview and worklists (OVR1-OVR11)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

REQUIRED, OPTIONAL = ["SI", "BL"], ["INVOICE"]
TYPES = REQUIRED + OPTIONAL
LABELS = {"SI": "Shipping Instruction", "BL": "Bill of Lading", "INVOICE": "Commercial Invoice"}


def documents(shipments: DataFrame, versions: DataFrame) -> DataFrame:
    """OVR1: one row per shipment and expected type, present or not.

    The three expected types are a literal array exploded in place, so there is no join
    to a dimension; counts come from one aggregate over the versions.
    """
    grid = shipments.select("shipment_key", F.explode(F.array(*[F.lit(t) for t in TYPES])).alias("doc_type"))
    c = versions.groupBy("shipment_key", "doc_type").agg(
        F.count_if(F.col("document_status") == "ACTIVE").alias("version_count"),
        F.max(F.when(F.col("is_latest"), F.col("version_number"))).alias("current_version"))
    return (grid.join(c, ["shipment_key", "doc_type"], "left")
            .withColumn("version_count", F.coalesce("version_count", F.lit(0))).withColumn("present", F.col("version_count") > 0))


def _types(cond: str, wanted: list[str]) -> Column:
    """Ordered array of types that satisfy a flag, from one aggregate per shipment."""
    return F.array_compact(F.array(*[F.when(F.bool_or(F.when(F.col("doc_type") == t, F.col(cond))), F.lit(t)) for t in wanted]))


def missing_types(docs: DataFrame) -> DataFrame:
    """OVR2: missing required and optional types, and completeness."""
    d = docs.withColumn("absent", ~F.col("present"))
    g = d.groupBy("shipment_key").agg(_types("absent", REQUIRED).alias("missing_documents"),
                                      _types("absent", OPTIONAL).alias("missing_optional"), F.bool_or("present").alias("has_any"))
    return g.withColumn("complete", F.size("missing_documents") == 0)


def representative_report(versions: DataFrame, reports: DataFrame) -> DataFrame:
    """OVR3: newest comparison report behind a shipment's documents, else the newest report."""
    links = versions.select("shipment_key", "email_id").filter("email_id IS NOT NULL").distinct()
    r = reports.select("email_id", "report_id", "category", "status", "review_reason", "has_defect")
    order = F.struct((F.col("category") == "BL_COMPARISON").alias("c"), F.col("report_id"))
    row = F.max_by(F.struct("report_id", "category", "status", "review_reason", "has_defect"), order).alias("r")
    return links.join(r, "email_id").groupBy("shipment_key").agg(row).select("shipment_key", "r.*")


def overview(shipments: DataFrame, versions: DataFrame, issues: DataFrame, reports: DataFrame) -> DataFrame:
    """OVR1-OVR6 on one row per shipment: status, reasons, actions.

    Every input is reduced to one row per shipment before it is joined.
    """
    base = missing_types(documents(shipments, versions))
    live = issues.filter("status <> 'SUPERSEDED'").groupBy("shipment_key").agg(
        F.array_sort(F.collect_set("field_name")).alias("mismatch_fields"), F.count(F.lit(1)).alias("issue_count"))
    rep = representative_report(versions, reports).select("shipment_key", F.col("status").alias("report_status"), F.col("review_reason").alias("report_reason"))
    df = base.join(live, "shipment_key", "left").join(rep, "shipment_key", "left")
    df = (df.withColumn("mismatch_fields", F.coalesce("mismatch_fields", F.array().cast("array<string>")))
          .withColumn("issue_count", F.coalesce("issue_count", F.lit(0))))
    no = lambda t: F.array_contains("missing_documents", t)
    review = F.coalesce(F.col("report_status") == "NEEDS_REVIEW", F.lit(False))
    mism = F.size("mismatch_fields") > 0
    df = df.withColumn("status", F.when(~F.col("has_any"), "PROCESSING").when(no("SI"), "INCOMPLETE")
                       .when(no("BL") | mism | review, "NEEDS_ATTENTION").otherwise("VERIFIED"))
    reasons = F.array_compact(F.array(
        *[F.when(no(t), F.lit("Missing " + LABELS[t])) for t in REQUIRED],
        F.when(mism, F.concat(F.lit("Field mismatch: "), F.array_join("mismatch_fields", ", "))),
        F.when(review, F.concat(F.lit("Needs review: "), F.col("report_reason")))))
    actions = F.array_compact(F.array(
        F.when(no("BL"), F.lit("REQUEST_BL")), F.when(no("SI"), F.lit("REQUEST_SI")), F.when(mism, F.lit("REQUEST_CORRECTION")),
        F.when(review, F.lit("MANUAL_REVIEW")), F.when(F.col("status") == "VERIFIED", F.lit("NO_ACTION"))))
    return df.withColumn("reasons", reasons).withColumn("actions", actions)


def source_mails(versions: DataFrame, mails: DataFrame) -> DataFrame:
    """OVR7: mails behind a shipment with the files they contributed.

    The list is per (shipment, mail): a mail's attachments bound it.
    """
    g = versions.filter("email_id IS NOT NULL").groupBy("shipment_key", "email_id").agg(
        F.array_sort(F.collect_list("filename")).alias("files"), F.array_sort(F.collect_set("doc_type")).alias("document_types"))
    return g.join(mails.select("email_id", "sender", "subject"), "email_id", "left")


def resolution_label(resolved: Column, pending: Column, mismatches: Column) -> Column:
    """OVR10."""
    return F.when(resolved > 0, "Resolved").when(pending > 0, "Pending").when(mismatches > 0, "Unresolved").otherwise("Clear")


def resolution_rank(label: Column) -> Column:
    return F.when(label == "Resolved", 4).when(label == "Pending", 3).when(label == "Unresolved", 2).otherwise(1)


def trade_lane(pol: Column, pod: Column, shipper: Column, consignee: Column) -> Column:
    """OVR11: ``POL → POD``; a party when no port is known."""
    a, b = F.trim(F.coalesce(pol, F.lit(""))), F.trim(F.coalesce(pod, F.lit("")))
    known = F.coalesce(F.when(a != "", a), F.lit("?")), F.coalesce(F.when(b != "", b), F.lit("?"))
    party = F.trim(F.coalesce(F.when(shipper != "", shipper), consignee, F.lit("")))
    return F.when((a != "") | (b != ""), F.concat(known[0], F.lit(" → "), known[1])).otherwise(party)


def work_flags(s: DataFrame) -> DataFrame:
    """FLT5: worklist membership as boolean columns.

    Needs status, mismatch_count, pending_count, resolved_count, missing_documents, reasons, actions.
    """
    mm, pend, res = (F.coalesce(c, F.lit(0)) for c in ("mismatch_count", "pending_count", "resolved_count"))
    lab = resolution_label(res, pend, mm)
    return (
        s.withColumn("resolution", lab)
        .withColumn("needs_attention", (F.col("status") == "NEEDS_ATTENTION") | (mm > 0) | (F.size("missing_documents") > 0) | (F.size("reasons") > 0))
        .withColumn("mismatch", mm > 0)
        .withColumn("needs_review", (F.col("status") == "NEEDS_REVIEW") | F.exists("reasons", lambda r: r.rlike("(?i)needs review|manual"))
                    | F.array_contains("actions", "MANUAL_REVIEW"))
        .withColumn("is_resolved", (lab == "Resolved") | ((res > 0) & (pend == 0) & (mm == 0)))
    )


def dashboard(flags: DataFrame) -> DataFrame:
    """OVR9: dashboard counters in one pass."""
    c = lambda x: F.count_if(F.col(x))
    return flags.agg(F.count(F.lit(1)).alias("all_shipments"), c("needs_attention").alias("needs_attention"), c("mismatch").alias("mismatch"),
                     c("needs_review").alias("needs_review"), c("is_resolved").alias("resolved"))
