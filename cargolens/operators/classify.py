"""Rule classification of mails (CLS1-CLS10) as one ordered CASE over flag columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import text as T
from .doctype import si_bl_of


def sender_domain(sender: Column) -> Column:
    s = F.lower(sender)
    tail = T.strip(F.regexp_replace(T.strip(F.substring_index(s, "@", -1)), r">+$", ""))
    return F.when(F.contains(s, F.lit("@")), tail).otherwise(F.lit(""))


def intent_hits(subject: Column, body: Column, hints: list[str]) -> Column:
    """CLS6: number of distinct hints found in subject or body."""
    found = [(F.contains(subject, F.lit(h)) | F.contains(body, F.lit(h))).cast("int") for h in hints]
    total = found[0]
    for f in found[1:]:
        total = total + f
    return total


def _texts(sender: Column, subject: Column, body: Column, attachments: Column) -> Column:
    """What the rules look at: each text of a mail lower-cased once."""
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.struct(text(subject).alias("subj"), text(body).alias("body"), text(sender).alias("sender"),
                    sender_domain(F.coalesce(sender, F.lit(""))).alias("dom"),
                    F.transform(F.coalesce(attachments, F.array().cast("array<string>")), F.lower).alias("att"))


def _attached(m: Column) -> Column:
    """CLS1: which of SI and BL a mail's attachments claim."""
    def claimed(kind):
        k = kind.lower()
        return F.exists(m["att"], lambda a: T.contains_any(a, [f"_{k}.", f"_{k}_", f"{k}.frombody"])
                        | F.coalesce(si_bl_of(a) == kind, F.lit(False)))

    return F.struct(claimed("SI").alias("has_si"), claimed("BL").alias("has_bl"))


def flags_of(sender: Column, subject: Column, body: Column, attachments: Column) -> Column:
    """CLS1-CLS8: all rule predicates of one mail as a struct."""
    return T.let(_texts(sender, subject, body, attachments), lambda m: T.let(_attached(m), lambda a: _flags(m, a)))


def _flags(m: Column, attached: Column) -> Column:
    subj, body, dom = m["subj"], m["body"], m["dom"]
    return F.struct(
        attached["has_si"].alias("has_si"), attached["has_bl"].alias("has_bl"),
        subj.rlike(rules.SUBJECT_IS_SI).alias("subject_si"), subj.rlike(rules.SUBJECT_IS_BL).alias("subject_bl"),
        subj.rlike(rules.SPAM_SUBJECT_WORD).alias("spam_word"),
        (T.contains_any(dom, rules.SPAM_DOMAIN_HINTS) | dom.rlike(r"\bspam\b")).alias("spam_domain"),
        (F.when(T.contains_any(subj, rules.SPAM_SUBJECT_HINTS), 2).otherwise(0)
         + F.when(T.contains_any(body, rules.SPAM_BODY_HINTS), 1).otherwise(0)).alias("spam_score"),
        (T.contains_any(subj, rules.SYSTEM_SUBJECTS) | F.contains(m["sender"], F.lit(rules.SYSTEM_SENDER))).alias("system_mail"),
        (T.contains_any(subj, rules.INTERNAL_MARKERS) | T.contains_any(body, rules.INTERNAL_MARKERS)).alias("internal_mail"),
        intent_hits(subj, body, rules.BL_REQUEST_HINTS).alias("bl_hits"),
        intent_hits(subj, body, rules.SI_REQUEST_HINTS).alias("si_hits"),
        intent_hits(subj, body, rules.INVOICE_HINTS).alias("inv_hits"),
    )


MAIL = ("sender", "subject", "body", "attachments")


def with_flags(mails: DataFrame) -> DataFrame:
    """The rule predicates as columns; every mail is scanned once."""
    return mails.withColumn("_f", flags_of(*[F.col(c) for c in MAIL])).select("*", "_f.*").drop("_f")


def best_intent(f: Column, top: Column) -> Column:
    """CLS9: largest hit count; ties go to SI_REQUEST, INVOICE_QUERY, BL_COMPARISON."""
    return (F.when(f["si_hits"] == top, "SI_REQUEST").when(f["inv_hits"] == top, "INVOICE_QUERY").otherwise("BL_COMPARISON"))


def _outcome(category, confidence, reason) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(category).alias("category"), lit(confidence).cast("double").alias("confidence"),
                    lit(reason).alias("classify_reason"))


def _both_attached(subject_si: Column, subject_bl: Column) -> Column:
    """The first rules: with both documents attached only the subject is asked."""
    return (F.when(subject_si & ~subject_bl, _outcome("SI_REQUEST", 0.95, "subject asks for an SI, both documents attached"))
            .otherwise(_outcome("BL_COMPARISON", 0.95, "both documents attached")))


def verdict_of(f: Column) -> Column:
    """Ordered rules over the flags struct of a mail without both documents: category, confidence and reason."""
    top = F.greatest(f["si_hits"], f["inv_hits"], f["bl_hits"])
    return (
        F.when(f["spam_word"], _outcome("SPAM", 0.99, "subject names spam"))
        .when(f["spam_domain"], _outcome("SPAM", 0.95, "sender on the spam list"))
        .when(f["spam_score"] >= 3, _outcome("SPAM", 0.9, F.concat(F.lit("spam score "), f["spam_score"].cast("string"))))
        .when(f["system_mail"], _outcome("GENERAL", 0.95, "automatic notice"))
        .when((f["has_si"] | f["has_bl"]) & (f["bl_hits"] >= 1), _outcome("BL_COMPARISON", 0.7, "one document attached, text about a BL"))
        .when(f["internal_mail"], _outcome("GENERAL", 0.7, "internal notice"))
        .when(top > 0, _outcome(best_intent(f, top), F.least(F.lit(0.5) + F.lit(0.15) * top, F.lit(0.9)),
                                F.concat(F.lit("words found: "), top.cast("string"))))
        .otherwise(_outcome("GENERAL", 0.6, "no rule applies"))
    )


def category_of(sender: Column, subject: Column, body: Column, attachments: Column) -> Column:
    """CLS9: the ordered rules on a mail; the words of all other rules are searched only where not both documents are attached."""
    def rules_of(m):
        both = _both_attached(m["subj"].rlike(rules.SUBJECT_IS_SI), m["subj"].rlike(rules.SUBJECT_IS_BL))
        return T.let(_attached(m), lambda a: F.when(a["has_si"] & a["has_bl"], both).otherwise(T.let(_flags(m, a), verdict_of)))

    return T.let(_texts(sender, subject, body, attachments), rules_of)


def classify(mails: DataFrame) -> DataFrame:
    """Add category, confidence, classify_reason and classify_source."""
    df = mails.withColumn("_c", category_of(*[F.col(c) for c in MAIL]))
    return df.select("*", "_c.*", F.lit("rule-classifier").alias("classify_source")).drop("_c")


def with_source(reports: DataFrame) -> DataFrame:
    """CLS10: provider column with nulls backfilled."""
    return reports.withColumn("classify_source", F.coalesce("classify_source", F.lit("rule-classifier")))


def is_document_request(body: Column) -> Column:
    """FLT10: asks to be sent documents, and neither misses any nor asks to compare."""
    b = F.coalesce(body, F.lit(""))
    return b.rlike(rules.DOCUMENT_REQUEST) & ~b.rlike(rules.DECLARED_MISSING) & ~b.rlike(rules.ASKED_TO_COMPARE)
