"""Field comparison and the verdict per mail (CMP1-CMP18)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import text as T
from . import classify as C, doctype as D, extract as X

MATCH, DIFF, POSSIBLE, UNDECIDABLE = "MATCH", "DIFF", "POSSIBLE", "UNDECIDABLE"


def fuzzy_close(a: Column, b: Column) -> Column:
    """CMP4: unequal and at most two edits apart."""
    return (a != b) & (F.levenshtein(a, b, 2) >= 0)


def match_of(field: str, a: Column, b: Column) -> Column:
    """CMP2-CMP5: outcome of one field from the normalised values of both sides."""
    if field == "gross_weight_kg":
        rule = F.when(F.abs(a - b) < 0.001, MATCH).otherwise(DIFF)
    elif field in rules.PORT_FIELDS:
        one_code = a["code"].isNotNull() != b["code"].isNotNull()
        va, vb = a["value"], b["value"]
        rule = (
            F.when((va == vb) | (one_code & (a["name"] == b["name"])), MATCH)
            .when(fuzzy_close(va, vb), POSSIBLE).otherwise(DIFF)
        )
    elif field in rules.NAME_FIELDS:
        rule = F.when(a == b, MATCH).when(fuzzy_close(a, b), POSSIBLE).otherwise(DIFF)
    else:
        rule = F.when(a == b, MATCH).otherwise(DIFF)
    return F.when(a.isNull() | b.isNull(), UNDECIDABLE).otherwise(rule)


def match_as_printed(field: str, a: Column, b: Column) -> Column:
    """The same outcome from the values as printed: equal ones have equal normalised forms, which are worked out for others only."""
    if field not in (*rules.NAME_FIELDS, *rules.PORT_FIELDS):
        return match_of(field, a, b)
    forms = F.struct(X.normal_value(field, a).alias("a"), X.normal_value(field, b).alias("b"))
    return (F.when(a.isNull() | b.isNull(), UNDECIDABLE).when(a == b, MATCH)
            .otherwise(T.let(forms, lambda n: match_of(field, n["a"], n["b"]))))


def printed(value: Column, field: str) -> Column:
    """A field value as text; whole weights without a decimal tail."""
    if field == "gross_weight_kg":
        return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def field_results(si: Column, bl: Column, si_norm: Column | None = None, bl_norm: Column | None = None) -> Column:
    """CMP1/CMP6: one entry per compared field, plus dates that either side prints; normalised structs are used where they are at hand."""
    match = lambda f: match_as_printed(f, si[f], bl[f]) if si_norm is None else match_of(f, si_norm[f], bl_norm[f])
    rows = [
        F.struct(F.lit(f).alias("field"), printed(si[f], f).alias("si_value"), printed(bl[f], f).alias("bl_value"), match(f).alias("match"))
        for f in rules.ALL_FIELDS
    ]
    shown = lambda r: ~r["field"].isin(rules.INFO_FIELDS) | r["si_value"].isNotNull() | r["bl_value"].isNotNull()
    return F.filter(F.array(*rows), shown)


def fields_with(results: Column, outcome: str) -> Column:
    """Scored fields with an outcome, in canonical order."""
    return F.transform(
        F.filter(results, lambda r: (r["match"] == outcome) & ~r["field"].isin(rules.INFO_FIELDS)), lambda r: r["field"])


def roll_up(df: DataFrame, results: str = "field_results") -> DataFrame:
    """CMP7: undecidable > defect > possible > OK."""
    r = F.col(results)
    df = (df.withColumn("undecidable_fields", fields_with(r, UNDECIDABLE))
          .withColumn("possible_fields", fields_with(r, POSSIBLE))
          .withColumn("_diff", fields_with(r, DIFF)))
    und, pos, diff = (F.size(c) > 0 for c in ("undecidable_fields", "possible_fields", "_diff"))
    return (
        df.withColumn("status", F.when(und, "NEEDS_REVIEW").when(diff, "MISMATCH").when(pos, "NEEDS_REVIEW").otherwise("OK"))
        .withColumn("review_reason", F.when(und, "missing_value").when(~diff & pos, "possible_match"))
        .withColumn("has_defect", ~und & diff)
        .withColumn("defect_fields", F.when(und, F.array().cast("array<string>")).otherwise(F.col("_diff")))
        .drop("_diff")
    )


def read_documents(docs: DataFrame) -> DataFrame:
    """Per document (path, text, source?): fields, normalised form and reading flags."""
    if "source" not in docs.columns:
        docs = docs.withColumn("source", F.lit("txt"))
    df = X.with_fields(docs.withColumn("unreadable", T.unreadable(F.coalesce("text", F.lit("")))))
    df = df.withColumn("norm", X.normalised(F.col("fields"))).withColumn("missing", X.missing_fields(F.col("fields")))
    return (
        df.withColumn("declared", D.declared_type(F.col("text")))
        .withColumn("readable", ~F.col("unreadable"))
        # A text of white space alone has no label, so no field has to be read to see that it holds nothing.
        .withColumn("nothing", F.col("unreadable") | F.col("text").isNull() | (T.strip(F.col("text")) == ""))
        .drop("unreadable")
    )


def compare_pairs(si: DataFrame, bl: DataFrame, on: list[str]) -> DataFrame:
    """CMP1-CMP7 for two frames of read documents joined on their key."""
    pick = lambda d, p: d.select(*on, F.col("fields").alias(p), F.col("norm").alias(p + "_norm"))
    joined = pick(si, "si").join(pick(bl, "bl"), on)
    # Normalised forms are worked out for values that are printed differently; the columns are for callers that take them.
    return roll_up(joined.withColumn("field_results", field_results(F.col("si"), F.col("bl"))))


def verdicts(mails: DataFrame, docs: DataFrame) -> DataFrame:
    """CMP12/CMP13: the complete verdict of every mail.

    ``mails(email_id, sender, subject, body, attachments)``, ``docs(path, text[, source])``.
    Mails are projected to ids and paths before the join, documents to fields, so neither
    bodies nor texts are shuffled. A mail becomes a row per slot, so that each document is
    read and joined once; an aggregate brings the slots together again. What a document
    looks like and what its fields say travel apart, so a caller that takes no column of
    the comparison has no field read. Values are normalised for the pairs that print them
    differently, not for every document.
    """
    m = D.with_pair(C.classify(mails)).withColumn("is_request", C.is_document_request(F.col("body")))
    compared = F.col("category") == "BL_COMPARISON"
    paired = compared & F.col("si_path").isNotNull() & F.col("bl_path").isNotNull()
    m = m.withColumn("_go", paired).drop("body", "subject", "attachments", "sender")
    # Both structs are there for every document, so the first ones of a slot are of one row.
    read = read_documents(docs).select(
        "path", F.struct("declared", "readable", "nothing", "source").alias("_doc"), F.struct("fields", "missing").alias("_read"))
    slot = lambda name, path: F.struct(F.lit(name).alias("slot"), path.alias("path"))
    # Mails without a pair get a path that matches nothing, so they spread over all tasks.
    slots = F.when(F.col("_go"), F.array(slot("si", F.col("si_path")), slot("bl", F.col("bl_path")))).otherwise(
        F.array(slot("none", F.concat(F.lit("\u0001"), F.col("email_id")))))
    keys = ["email_id", "si_path", "bl_path"]
    rest = [c for c in m.columns if c not in keys]
    joined = m.withColumn("_slot", F.explode(slots)).join(read, F.col("_slot.path") == F.col("path"), "left")
    of = lambda name, part: F.first(F.when(F.col("_slot.slot") == name, F.col(part)), ignorenulls=True).alias(name + part)
    m = joined.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], *[of(name, part) for part in ("_doc", "_read") for name in ("si", "bl")])
    return decide(m).drop("_go", "si_doc", "bl_doc", "si_read", "bl_read")


def decide(m: DataFrame) -> DataFrame:
    """All predicates as columns, then one ordered CASE for status and reason."""
    go = F.col("_go")
    for s, slot in (("si", "SI"), ("bl", "BL")):
        d, r = F.col(s + "_doc"), F.col(s + "_read")
        m = (
            m.withColumn(s + "_wrong", go & D.wrong_type(d["declared"], slot))
            .withColumn(s + "_nothing", go & F.coalesce(d["nothing"], F.lit(True)))
            .withColumn(s + "_ocr", go & F.coalesce(
                F.endswith(d["source"], F.lit("-ocr")) & ((F.size(r["missing"]) > 0) | ~d["readable"]), F.lit(False)))
        )
    m = m.withColumn("_results", F.when(go, field_results(F.col("si_read.fields"), F.col("bl_read.fields"))))
    m = roll_up(m, "_results")
    none = F.array().cast("array<string>")
    pair_of = lambda a, b: F.array_compact(F.array(F.when(a, F.lit("SI")), F.when(b, F.lit("BL"))))
    m = m.withColumn("missing_documents", F.when((F.col("category") == "BL_COMPARISON") & ~go & ~F.col("is_request"),
                                                 pair_of(F.col("si_path").isNull(), F.col("bl_path").isNull())).otherwise(none))
    # What stops a comparison before a field is looked at, and the step that takes the fields into account.
    stop = (
        F.when(F.col("category") != "BL_COMPARISON", "skip")
        .when(~go & F.col("is_request"), "request")
        .when(~go, "missing")
        .when(F.col("si_wrong") | F.col("bl_wrong"), "wrong")
        .when(F.col("si_nothing") | F.col("bl_nothing"), "unreadable")
    )
    m = m.withColumn("_stop", stop)
    m = m.withColumn("_step", F.coalesce("_stop", F.when(F.col("si_ocr") | F.col("bl_ocr"), "ocr").otherwise("compare")))
    compared = F.col("_step") == "compare"
    wrong, unread, ocr = (pair_of(F.col("si_" + x), F.col("bl_" + x)) for x in ("wrong", "nothing", "ocr"))
    reads_as = lambda s, l: F.when(F.col(s + "_wrong"), F.concat(
        F.lit(f"{l} reads as a "), F.initcap(F.regexp_replace(F.col(s + "_doc.declared"), "_", " "))))
    evidence = (
        F.when(F.col("_step") == "request", "The mail asks for documents and brings none to compare.")
        .when(F.col("_step") == "missing", F.concat(F.lit("A pair needs SI and BL; not attached: "), F.array_join("missing_documents", ", ")))
        .when(F.col("_step") == "wrong", F.concat(
            F.lit("Another kind of document is attached: "),
            F.concat_ws("; ", reads_as("si", "SI"), reads_as("bl", "BL")),
            F.lit(".")))
        .when(F.col("_step") == "unreadable", F.concat(
            F.lit("No readable text in: "), F.array_join(unread, ", "),
            F.lit(".")))
        .when(F.col("_step") == "ocr", F.concat(
            F.lit("Recognised text of "), F.array_join(ocr, ", "), F.lit(" lacks fields.")))
    )
    return (
        m.withColumn("status", F.when(F.col("_step") == "skip", "SKIPPED").when(F.col("_step") == "request", "OK")
                     .when(compared, F.col("status")).otherwise("NEEDS_REVIEW"))
        .withColumn("review_reason", F.when(compared, F.col("review_reason")).when(F.col("_step") == "missing", "missing_attachment")
                    .when(F.col("_step") == "wrong", "wrong_doc_type").when(F.col("_step").isin("unreadable", "ocr"), "unreadable"))
        .withColumn("has_defect", compared & F.col("has_defect"))
        .withColumn("defect_fields", F.when(compared, F.col("defect_fields")).otherwise(none))
        .withColumn("possible_fields", F.when(compared, F.col("possible_fields")).otherwise(none))
        .withColumn("undecidable_fields", F.when(compared, F.col("undecidable_fields")).otherwise(none))
        .withColumn("field_results", F.when(compared, F.col("_results")))
        .withColumn("action", F.when(F.col("_step") == "request", "document_request"))
        .withColumn("wrong_documents", F.when(F.col("_stop") == "wrong", wrong).otherwise(none))
        .withColumn("unreadable_documents", F.when(F.col("_stop") == "unreadable", unread).otherwise(none))
        .withColumn("present_documents", F.when(F.col("_stop") == "missing", pair_of(
            F.col("si_path").isNotNull(), F.col("bl_path").isNotNull())).otherwise(none))
        .withColumn("evidence", evidence)
        .withColumn("si_fields", F.when(go, F.col("si_read.fields")))
        .withColumn("bl_fields", F.when(go, F.col("bl_read.fields")))
        .drop("_results", "_stop", "_step", "si_wrong", "bl_wrong", "si_nothing", "bl_nothing", "si_ocr", "bl_ocr", "is_request")
    )


# ------------------------------------------------------------------ derived texts
def general_format(x: Column) -> Column:
    """Six significant digits without trailing zeros, as C's %g prints them."""
    sci = F.format_string("%.5e", x)
    power = F.regexp_extract(sci, r"e([+-]\d+)$", 1).try_cast("int")
    plain = F.regexp_replace(sci.try_cast("decimal(38,12)").cast("string"), r"(?:\.0+|(\.\d*?)0+)$", "$1")
    short = F.regexp_replace(sci, r"(?:\.0+|(\.\d*?)0+)e", "$1e")
    return F.when(x.isNotNull(), F.when((power < -4) | (power >= 6), short).otherwise(plain))


def difference(field: Column, si: Column, bl: Column) -> Column:
    """CMP8: size of a weight or count difference, as text; null for other fields."""
    gap = F.abs(bl.try_cast("double") - si.try_cast("double"))
    return (
        F.when(field == "gross_weight_kg", F.concat(general_format(gap), F.lit(" kg")))
        .when(field == "container_count", F.concat(gap.cast("bigint").cast("string"), F.lit(" container(s)")))
    )


def explanation(field: Column, diff: Column) -> Column:
    """CMP9: one deterministic sentence per differing field."""
    label = F.regexp_replace(field, "_", " ")
    return F.coalesce(
        F.concat(F.lit("BL "), label, F.lit(" differs from SI by "), diff, F.lit(".")),
        F.concat(F.lit("BL "), label, F.lit(" differs from the SI value.")))


def severity(field: Column) -> Column:
    """CMP10."""
    return (F.when(field.isin("consignee", "notify_party"), "high")
            .when(field.isin("gross_weight_kg", "container_count"), "med").otherwise("low"))


def release_action(category: Column, status: Column) -> Column:
    """CMP18: what to do with the bill of lading."""
    return (
        F.when(status == "OK", "RELEASE_BL").when(status == "MISMATCH", "HOLD_BL_RELEASE")
        .when(status == "NEEDS_REVIEW", "HUMAN_REVIEW")
        .when(category == "SI_REQUEST", "ROUTE_TO_SI_REQUEST").otherwise("NO_ACTION")
    )


def suggested_action(df: DataFrame) -> DataFrame:
    """CMP14/CMP15: action text and structured action; a security finding comes first.

    Needs category, status, review_reason, defect_fields, missing_documents and
    unreadable_documents; ``security_alert BOOLEAN`` is optional.
    """
    alert = F.col("security_alert") if "security_alert" in df.columns else F.lit(False)
    reason = F.coalesce("review_reason", F.lit("undecidable"))
    text = (
        F.when(alert, "QUARANTINE_AND_ALERT_SECURITY")
        .when(F.col("status") == "SKIPPED", F.concat(F.lit("ROUTE_TO_"), F.col("category")))
        .when(F.col("status") == "MISMATCH", F.concat(F.lit("NOTIFY_FORWARDER_AMENDMENT: "), F.array_join("defect_fields", ", ")))
        .when((F.col("status") == "NEEDS_REVIEW") & (reason == "missing_attachment"),
              F.concat(F.lit("REQUEST_MISSING_DOCUMENTS: "), F.array_join("missing_documents", ", ")))
        .when((F.col("status") == "NEEDS_REVIEW") & (reason == "unreadable"),
              F.concat(F.lit("MANUAL_REVIEW_UNREADABLE: "), F.array_join("unreadable_documents", ", ")))
        .when(F.col("status") == "NEEDS_REVIEW", F.concat(F.lit("ESCALATE_TO_REVIEW_DESK: "), reason))
        .otherwise("AUTO_APPROVE")
    )
    first = F.get("missing_documents", F.lit(0))
    wants = (F.col("status") == "NEEDS_REVIEW") & (reason == "missing_attachment") & first.isNotNull()
    kind = (F.when(alert, "quarantine").when(wants, "request_document").when(F.col("status") == "MISMATCH", "review_mismatch")
            .when(F.col("status") == "NEEDS_REVIEW", "manual_review"))
    label = (F.when(alert, "Quarantine attachment").when(wants, F.concat(F.lit("Request "), first))
             .when(F.col("status") == "MISMATCH", "Review mismatch").when(F.col("status") == "NEEDS_REVIEW", "Open review"))
    out = (df.withColumn("suggested_action", text).withColumn("action_type", kind).withColumn("action_label", label))
    return (
        out.withColumn("review_reason", F.when(alert, "security_quarantine").otherwise(F.col("review_reason")))
        .withColumn("status", F.when(alert, "ERROR").otherwise(F.col("status")))
        .withColumn("category", F.when(alert, "SPAM").otherwise(F.col("category")))
    )


DIFF_CELLS = 60_000  # a longer pair of values is shown whole and not token by token


def tokens(value: Column) -> Column:
    """CMP11: words with their inner marks, white-space runs and runs of other characters, in order."""
    return F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(rf"[A-Za-z0-9]+(?:[.'\u2019/-][A-Za-z0-9]+)*|{T.WS}+|(?:(?!{T.WS})[^A-Za-z0-9])+"), F.lit(0))


def aligned_difference(left: Column, right: Column) -> Column:
    """CMP11: the ordered difference of two token arrays, ``ARRAY<STRUCT<op,token>>`` with op same, del or ins.

    Lengths of longest common subsequences of the tails are filled row by row from the
    end, then walked from the start: equal tokens are the same, else the token goes whose
    removal keeps the longer rest, a deletion first. Null where one side has no token or the
    table would exceed its bound, as the reader then sees both values whole.
    """
    pair = F.struct(left.alias("a"), right.alias("b"))

    def table(p: Column) -> Column:
        """Rows for tails of a, the empty tail first; in a row the tails of b likewise."""
        zeros = F.array_repeat(F.lit(0), F.size(p["b"]) + 1)

        def next_row(rows: Column, x: Column) -> Column:
            def filled(above: Column) -> Column:
                def cell(row: Column, k: Column) -> Column:
                    same = F.get(p["b"], F.size(p["b"]) - k) == x
                    value = F.when(same, F.get(above, k - 1) + 1).otherwise(F.greatest(F.get(above, k), F.get(row, k - 1)))
                    return F.concat(row, F.array(value))

                return F.aggregate(F.sequence(F.lit(1), F.size(p["b"])), F.array(F.lit(0)), cell)

            return F.concat(rows, F.array(T.let(F.element_at(rows, -1), filled)))

        return F.aggregate(F.reverse(p["a"]), F.array(zeros), next_row)

    def walk(p: Column, rows: Column) -> Column:
        n, m = F.size(p["a"]), F.size(p["b"])
        tail = lambda i, j: F.get(F.get(rows, n - i), m - j)
        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.array().cast("array<struct<op:string,token:string>>").alias("ops"))

        def step(s: Column, _: Column) -> Column:
            i, j = s["i"], s["j"]
            x, y = F.get(p["a"], i), F.get(p["b"], j)
            same = (i < n) & (j < m) & (x == y)
            gone = (j >= m) | ((i < n) & (tail(i + 1, j) >= tail(i, j + 1)))
            op = F.when(same, F.struct(F.lit("same").alias("op"), x.alias("token"))).when(gone, F.struct(F.lit("del").alias("op"), x.alias("token"))).otherwise(
                F.struct(F.lit("ins").alias("op"), y.alias("token")))
            moved = F.struct((i + F.when(same | gone, 1).otherwise(0)).alias("i"), (j + F.when(same | ~gone, 1).otherwise(0)).alias("j"), F.concat(s["ops"], F.array(op)).alias("ops"))
            return F.when((i >= n) & (j >= m), s).otherwise(moved)

        return F.aggregate(F.sequence(F.lit(1), n + m), zero, step)["ops"]

    fits = lambda p: (F.size(p["a"]) > 0) & (F.size(p["b"]) > 0) & (F.size(p["a"]).cast("long") * F.size(p["b"]) <= DIFF_CELLS)
    return T.let(pair, lambda p: F.when(fits(p), T.let(table(p), lambda rows: walk(p, rows))))
