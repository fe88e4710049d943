"""Document typing by name and heading, SI/BL pairing (DOC1-DOC11)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import text as T
from .extract import ANY_OPENING


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def si_bl_of(name: Column) -> Column:
    """DOC1: SI or BL claimed by exactly one side of a document name."""
    stem = F.lower(F.regexp_extract(name, r"(?s)^(.+)\.[^.]*\z", 1))
    suffix = F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)\z", 1))

    def claim(s, words, phrases):
        # A word between signs, or a phrase however its letters are set apart; a short pattern per side, no list is built.
        apart = "|".join("[^a-z0-9]*".join(p) for p in phrases)
        return s.rlike(rf"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])|{apart}")

    def kind(s):
        return T.let(F.struct(claim(s, rules.SI_TOKENS, rules.SI_PHRASES).alias("si"), claim(s, rules.BL_TOKENS, rules.BL_PHRASES).alias("bl")),
                     lambda c: F.when(c["si"] & ~c["bl"], "SI").when(c["bl"] & ~c["si"], "BL"))

    return F.when(suffix.isin(rules.DOC_SUFFIXES), T.let(stem, kind))


def kind_of(name: Column) -> Column:
    """DOC2: SI/BL first, then INVOICE."""
    return F.coalesce(si_bl_of(name), F.when(name.rlike(rules.INVOICE_NAME), "INVOICE"))


def is_synthetic(name: Column) -> Column:
    """DOC3: a document made from a mail body."""
    return F.contains(F.lower(name), F.lit(rules.SYNTHETIC_MARK))


def with_pair(mails: DataFrame, attachments: str = "attachments") -> DataFrame:
    """DOC4: the SI and BL attachment of each mail.

    A mail's attachment list is small, so both tiers are array expressions: no
    explode, no window, no shuffle. The looser second tier is asked only where the first
    has found none.
    """
    att = F.col(attachments)
    ordered = F.concat(F.filter(att, lambda a: ~is_synthetic(a)), F.filter(att, is_synthetic))
    df = mails.withColumn("_ord", ordered)

    def first(cond):
        return F.get(F.filter(F.col("_ord"), cond), 0)

    df = df.withColumn("_s1", first(lambda a: a.rlike(r"(?i)_SI\.[a-z]+$"))).withColumn("_b1", first(lambda a: a.rlike(r"(?i)_BL\.[a-z]+$")))
    free = lambda a: ~F.coalesce(a == F.col("_s1"), F.lit(False)) & ~F.coalesce(a == F.col("_b1"), F.lit(False))
    return (
        df.withColumn("si_path", F.coalesce("_s1", first(lambda a: free(a) & (si_bl_of(a) == "SI"))))
        .withColumn("bl_path", F.coalesce("_b1", first(lambda a: free(a) & (si_bl_of(a) == "BL"))))
        .drop("_ord", "_s1", "_b1")
    )


def declared_type(text: Column) -> Column:
    """DOC5: what a document calls itself in its first title line that opens no field: a label there has no separator of its own."""
    lines = T.split_lines(text)

    def title(l):
        out = F.when(l.rlike("(?i)" + rules.DOC_TITLES[0][0]), rules.DOC_TITLES[0][1])
        for pattern, kind in rules.DOC_TITLES[1:]:
            out = out.when(l.rlike("(?i)" + pattern), kind)
        return out

    any_title = "(?i)" + T.grouped([pattern for pattern, _ in rules.DOC_TITLES])
    def first(found, l):  # lines below the title are not searched
        opens = l.rlike(r"[:：|\t]") & (l.rlike(ANY_OPENING) | T.squeeze(l).rlike(ANY_OPENING))  # no opening without a separator
        return F.when(found.isNotNull(), found).when(l.rlike(any_title) & ~opens, l)

    return T.let(F.aggregate(lines, F.lit(None).cast("string"), first), title)


def wrong_type(declared: Column, slot: str) -> Column:
    """DOC6: true only when a heading names another type; silence passes."""
    return F.coalesce(declared != slot, F.lit(False))


def loose_kind(name: Column) -> Column:
    """DOC7: looser reading of a name for per-document summaries."""
    n = F.lower(F.coalesce(name, F.lit("")))
    compact = F.regexp_replace(n, r"[^\p{L}\p{N}]", "")
    token = r"(?:^|[^a-z]){}(?:[^a-z]|$)"
    return (
        F.when(F.contains(compact, F.lit("shippinginstruction")) | n.rlike(token.format("si")), "SI")
        .when(T.contains_any(compact, ["billoflading", "draftbl"]) | n.rlike(token.format("bl")), "BL")
        .when(n.rlike("invoice|_inv|^inv"), "INVOICE")
    )


def mail_reference(subject: Column, body: Column, attachments: Column) -> Column:
    """DOC11: code written in the mail, else the token of the first ``<ref>_SI`` style name."""
    stated = F.regexp_extract(F.concat_ws("\n", subject, body), rules.COUNTERPART_REFERENCE, 0)
    tokens = F.transform(attachments, lambda a: F.regexp_extract(a, rules.PAIR_TOKEN, 1))
    token = F.get(F.filter(tokens, lambda t: t != ""), 0)
    return F.upper(F.coalesce(T.blank_to_null(stated), token))


def kinds_attached(attachments: Column) -> Column:
    """The SI/BL kinds real attachments cover."""
    kinds = F.transform(F.filter(attachments, lambda a: ~is_synthetic(a)), si_bl_of)
    return F.array_distinct(F.array_compact(kinds))


def with_inline_document(mails: DataFrame) -> DataFrame:
    """DOC9: a body that names exactly one uncovered kind becomes a fallback document.

    Adds ``inline_kind``, ``inline_path`` and ``inline_text`` (null when none).
    """
    subject, body = F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))
    both = F.concat_ws("\n", subject, body)
    named = F.array_compact(F.array(
        F.when(both.rlike(r"(?i)\bshipping\s+instruction\b"), "SI"),
        F.when(both.rlike(r"(?i)\bbill\s+of\s+lading\b"), "BL")))
    open_kinds = F.array_except(named, kinds_attached(F.col("attachments")))
    kind = F.when((F.size(open_kinds) == 1) & (body != ""), F.get(open_kinds, 0))
    code = F.coalesce(T.blank_to_null(F.regexp_extract(both, rules.COUNTERPART_REFERENCE, 0)), F.lit("UNKNOWN"))
    headed = (subject != "") & ~F.contains(F.lower(body), F.lower(subject))
    text = F.when(headed, F.concat(subject, F.lit("\n\n"), body)).otherwise(body)
    return (
        mails.withColumn("inline_kind", kind)
        .withColumn("inline_path", F.concat(code, F.lit("_"), F.col("inline_kind"), F.lit(rules.SYNTHETIC_MARK + ".txt")))
        .withColumn("inline_text", F.when(F.col("inline_kind").isNotNull(), text))
    )


def with_counterpart(mails: DataFrame, stored: DataFrame) -> DataFrame:
    """DOC10: a mail with one half gets the other half stored by another mail.

    ``stored(path)`` holds saved files named ``<ref>_<SI|BL>...``. The stored side is
    reduced to one path per (reference, kind) by a map-side ``min`` before the join,
    so a hot reference never meets its copies in one task. The first path is the
    first in sorted order; a path already attached is skipped.
    """
    name = base_name(F.col("path"))
    ref = F.upper(F.regexp_extract(name, r"(?i)^(.+?)_(SI|BL)", 1))
    kind = F.regexp_extract(name, r"^.+?_(SI|BL)", 1)
    best = (stored.select("path", ref.alias("ref"), kind.alias("other")).filter((F.col("ref") != "") & (F.col("other") != ""))
            .groupBy("ref", "other").agg(F.min("path").alias("counterpart_path")))
    kinds = kinds_attached(F.col("attachments"))
    df = (
        mails.withColumn("ref", mail_reference(F.col("subject"), F.col("body"), F.col("attachments")))
        .withColumn("other", F.when(F.size(kinds) == 1, F.when(F.get(kinds, 0) == "SI", "BL").otherwise("SI")))
    )
    # Mails that need no counterpart carry a key of their own, so nulls do not pile up.
    df = df.withColumn("ref", F.coalesce(F.when(F.col("other").isNotNull(), F.col("ref")),
                                         F.concat(F.lit("\u0001"), F.col("email_id"))))
    df = df.withColumn("other", F.coalesce("other", F.lit("")))
    return df.join(best, ["ref", "other"], "left").drop("ref", "other")
