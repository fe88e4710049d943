"""Shipment identity and grouping (SHP1-SHP7, EXT15-EXT18)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import text as T


def mail_code(subject: Column, body: Column, attachments: Column, strict: bool = False) -> Column:
    """SHP1: first reference in subject, body or attachment names.

    The default pattern is wide ("in 2026" and "SI/BL" match it too); ``strict`` asks
    for an upper-case code with digits.
    """
    text = F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit("")), F.array_join(attachments, " "))
    found = F.regexp_extract(text, rules.MAIL_REFERENCE_STRICT if strict else rules.MAIL_REFERENCE, 0)
    return T.blank_to_null(F.upper(F.regexp_replace(found, " ", "-")))


def identifiers(text: Column) -> Column:
    """EXT15-EXT17: identity signals one document prints."""
    return F.struct(T.document_reference(text).alias("reference"), T.container_numbers(text).alias("containers"),
                    T.vessel(text).alias("vessel"), T.voyage(text).alias("voyage"))


def discriminators(containers: Column, vessel: Column, voyage: Column) -> Column:
    """SHP3: what tells two shipments on one route apart, in a stable order."""
    boxes = F.when(F.size(containers) > 0, F.concat(F.lit("CTR:"), F.array_join(F.array_sort(F.array_distinct(containers)), ",")))
    ship = F.when(vessel.isNotNull() | voyage.isNotNull(), F.concat(
        F.lit("VES:"), F.upper(F.coalesce(vessel, F.lit(""))), F.lit(":"), F.upper(F.coalesce(voyage, F.lit("")))))
    return F.array_compact(F.array(boxes, ship))


def shipment_key(mail_ref: Column, doc_ref: Column, shipper: Column, pol: Column, pod: Column,
                 marks: Column, email_id: Column) -> Column:
    """SHP2: mail reference, document reference, field signature, mail id."""
    filled = lambda c: c.isNotNull() & (c != "")
    parts = F.array_join(F.concat(F.array(shipper, pol, pod), marks), "|")
    signed = F.when(filled(shipper) & filled(pol) & filled(pod), F.concat(F.lit("SIG:"), F.sha2(parts, 256)))
    return F.coalesce(F.concat(F.lit("REF:"), F.upper(mail_ref)), F.concat(F.lit("REF:"), F.upper(doc_ref)),
                      signed, F.concat(F.lit("EMAIL:"), email_id))


def signing_fields(si: Column, bl: Column) -> Column:
    """SHP4: shipper and ports for the signature, the instruction's values first."""
    return F.struct(*[F.coalesce(si[f], bl[f]).alias(f) for f in ("shipper", "port_of_loading", "port_of_discharge")])


def merge_identifiers(docs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """EXT18: first non-null scalars and first position of each container per group.

    Containers stay in long form (one row per group and container): a hot group's set
    is unbounded and must not meet in one array.
    """
    first = lambda c: F.min_by(F.col(f"ids.{c}"), F.when(F.col(f"ids.{c}").isNotNull(), F.col(order))).alias(c)
    return docs.groupBy(*keys).agg(first("reference"), first("vessel"), first("voyage"))


def merged_containers(docs: DataFrame, keys: list[str], order: str) -> DataFrame:
    return (docs.select(*keys, order, F.posexplode("ids.containers").alias("pos", "container"))
            .groupBy(*keys, "container").agg(F.min(F.struct(order, "pos")).alias("first")))


def shipments(registrations: DataFrame) -> DataFrame:
    """SHP5: one row per key with its first non-null reference."""
    ref = F.min_by("reference", F.when(F.col("reference").isNotNull(), F.col("reg_id")))
    return registrations.groupBy("shipment_key").agg(ref.alias("reference_number"), F.min("reg_id").alias("first_reg"))


def filed_documents(verdicts: DataFrame) -> DataFrame:
    """SHP6: documents to file: both of a pair, or the lone half of a carrying mail."""
    pair = F.col("si_path").isNotNull() & F.col("bl_path").isNotNull() & (F.col("category") == "BL_COMPARISON")
    lone = ~pair & F.col("category").isin("BL_COMPARISON", "SI_REQUEST")
    rows = F.array(F.struct(F.lit("SI").alias("doc_type"), F.col("si_path").alias("path")),
                   F.struct(F.lit("BL").alias("doc_type"), F.col("bl_path").alias("path")))
    # An empty array explodes to no row, so no filter on the computed columns is needed.
    keep = F.when(pair | lone, F.filter(rows, lambda r: r["path"].isNotNull()))
    return verdicts.select("email_id", (~pair).alias("lone"), F.inline(keep))


def attach_invoices(invoices: DataFrame, known: DataFrame) -> DataFrame:
    """SHP7: an invoice joins its own pair's shipment or an existing key, never a new one."""
    keyed = invoices.withColumn("shipment_key", F.coalesce("pair_key", "mail_key"))
    return keyed.join(known.select("shipment_key").distinct(), "shipment_key", "left_semi").drop("pair_key", "mail_key")
