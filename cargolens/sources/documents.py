"""Structured documents as label/value lines (SRC7-SRC13)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import text as T


# Tokens of compact JSON. Possessive quantifiers are matched without recursion, however long a text or list is.
JSON_SCALAR = r'"(?:[^"\\]|\\.)*+"|[^\[\]{},:"]++'
JSON_TOKEN = rf'"(?:[^"\\]|\\.)*+":|\[(?:(?:{JSON_SCALAR})(?:,(?:{JSON_SCALAR}))*+)?+\]|[\[\]{{}}]|{JSON_SCALAR}'
JSON_LEAF = "array<struct<label:string,token:string>>"
LEAVES = 512  # of one chunk of the fold's result


def _unquoted(token: Column) -> Column:
    """Text of a quoted JSON token; only one with an escape needs a parser."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(F.contains(token, F.lit("\\")), F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), 0)).otherwise(plain)


def json_leaves(text: Column) -> Column:
    """Scalars, and lists of scalars, of a compact JSON text with the labels of their paths: one fold over its tokens.

    The state is a stack with the label of every open container. Leaves are gathered in chunks,
    so that adding one does not copy all earlier ones.
    """
    zero = F.struct(F.array(F.lit("")).alias("open"), F.lit(None).cast("string").alias("named"),
                    F.array().cast(JSON_LEAF).alias("some"), F.array().cast(f"array<{JSON_LEAF}>").alias("all"))

    def step(s: Column, token: Column) -> Column:
        inside = F.element_at(s["open"], -1)
        label = F.coalesce(s["named"], inside)
        opens, closes, names = token.isin("{", "["), token.isin("}", "]"), F.endswith(token, F.lit('":'))
        leaf = ~(opens | closes | names)
        key = _unquoted(F.substring(token, F.lit(1), F.length(token) - 1))
        below = T.let(key, lambda k: F.when(F.lower(F.trim(k)).isin(rules.JSON_IGNORED_SEGMENTS), inside).otherwise(
            F.array_join(F.filter(F.array(inside, T.label_from_key(k)), lambda x: x != ""), " ")))
        full = F.size(s["some"]) >= LEAVES
        here = F.array(F.struct(label.alias("label"), token.alias("token")))
        return F.struct(
            F.when(opens, F.concat(s["open"], F.array(label))).when(closes, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"]).alias("open"),
            F.when(names, below).alias("named"),
            F.when(leaf, F.when(full, here).otherwise(F.concat(s["some"], here))).otherwise(s["some"]).alias("some"),
            F.when(leaf & full, F.concat(s["all"], F.array(s["some"]))).otherwise(s["all"]).alias("all"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(JSON_TOKEN), F.lit(0)), zero, step, lambda s: F.concat(F.flatten(s["all"]), s["some"]))


def flatten_json(docs: DataFrame) -> DataFrame:
    """SRC7: JSON documents as (path labels, value) rows, to any depth.

    One projection whose size does not depend on the data: the tokens of a document are folded
    with a stack (:func:`json_leaves`), so a document is read once and never leaves its task. A list
    of scalars is one value, joined by commas; other lists give their items the list's label.
    A value that spans lines gives a row per line. Null documents, empty containers and values
    without label or text give no row. ``docs(doc, v VARIANT)``.
    """
    rows = docs.select("doc", F.inline(json_leaves(F.to_json("v"))))
    printed = F.transform(F.regexp_extract_all("token", F.lit(JSON_SCALAR), F.lit(0)), lambda x: F.when(
        F.startswith(x, F.lit('"')), T.strip(F.regexp_replace(_unquoted(x), r"[^\S\n]+", " "))).when(x == "null", "").otherwise(scalar_text(x)))
    value = F.array_join(F.filter(printed, lambda x: x != ""), ", ")
    lines = rows.select("doc", "label", F.explode(F.split(value, "\n")).alias("value")).withColumn("value", T.strip(F.col("value")))
    return lines.filter("value <> '' AND label <> ''")


def scalar_text(raw: Column) -> Column:
    """A JSON scalar as a document prints it: grouped numbers, no booleans."""
    number = F.when(raw.rlike(r"^-?\d+(?:\.\d+)?$"), raw.try_cast("double"))
    whole = F.format_number(number, 0)
    cents = F.regexp_replace(F.format_number(number, 2), r"\.?0+$", "")
    shown = F.when(number == F.floor(number), whole).otherwise(cents)
    return F.coalesce(F.when(raw.isin("true", "false"), "").otherwise(F.coalesce(shown, T.strip(F.regexp_replace(raw, r"[^\S\n]+", " ")))), F.lit(""))


def json_lines(docs: DataFrame) -> DataFrame:
    """SRC8: one record per line; lines that do not parse are dropped. ``docs(doc, text)``."""
    lines = docs.select("doc", F.posexplode(T.split_lines(F.col("text"))).alias("line", "raw"))
    clean = F.regexp_replace(T.strip(F.col("raw")), r",+$", "")
    return lines.select("doc", "line", F.try_parse_json(F.when(~clean.isin("", "[", "]"), clean)).alias("v")).filter("v IS NOT NULL")


def csv_lines(text: Column) -> Column:
    """SRC9: cells of each record joined by `` | ``, blank cells and records dropped."""
    cells = lambda l: F.transform(F.regexp_extract_all(l, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1)),
                                  lambda c: T.strip(F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"'))))
    rows = F.transform(T.split_lines(text), lambda l: F.array_join(F.filter(cells(l), lambda c: c != ""), " | "))
    return T.clean_extracted(F.array_join(F.filter(rows, lambda r: r != ""), "\n"))


def xml_lines(text: Column) -> Column:
    """SRC10: ``Label | value`` for every element whose start tag is followed by text.

    Comments, declarations and instructions are skipped, CDATA is text, and entities are
    decoded once the tags are cut.
    """
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->|<\?.*?\?>|<!(?!\[CDATA\[)[^>]*>", ""), r"(?s)<!\[CDATA\[(.*?)\]\]>", _HELD_LT[0] + "$1" + _HELD_LT[1])
    # Inside CDATA a tag opener is text: it is held while tags are cut.
    held = F.array_join(F.transform(F.split(plain, _HELD_LT[0]), lambda p, i: F.when(i == 0, p).otherwise(
        F.concat(F.replace(F.replace(F.split_part(p, F.lit(_HELD_LT[1]), F.lit(1)), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.split_part(p, F.lit(_HELD_LT[1]), F.lit(2))))), "")
    tag = r"<(?:[\w.-]+:)?([A-Za-z_][\w.-]*)(?:\s[^>]*)?>([^<]*[^<\s][^<]*)(?=<)"

    def row(xml):
        return F.zip_with(F.regexp_extract_all(xml, F.lit(tag), F.lit(1)), F.regexp_extract_all(xml, F.lit(tag), F.lit(2)),
                          lambda k, v: F.concat(T.label_from_key(k), F.lit(" | "), T.squeeze(_decoded(v))))

    return F.array_join(T.let(held, row), "\n")


_HELD_LT = chr(0xE013), chr(0xE014)


def _decoded(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def edi_syntax(name: Column, text: Column) -> Column:
    """SRC13: header first, then suffix ``.x12``, three segment-like lines, other suffixes."""
    return (
        F.when(F.startswith(text, F.lit("ISA")), "x12").when(text.rlike("^(?:" + "|".join(rules.EDIFACT_HEADS) + ")"), "edifact")
        .when(F.endswith(F.lower(name), F.lit(".x12")), "x12")
        .when(F.regexp_count(text, F.lit(r"(?m)^[A-Z][A-Z0-9]{2}\+.*$")) >= 3, "edifact")
        .when(F.lower(name).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in rules.EDI_SUFFIXES) + ")$"), "edifact")
    )


# Private-use marks stand for delimiters and released characters while splitting.
_COMP, _ELEM, _TERM = chr(0xE010), chr(0xE011), chr(0xE012)
_HELD = "".join(map(chr, range(0xE000, 0xE004)))


def _translate(c: Column, old: Column, new: Column) -> Column:
    """``translate`` with column arguments."""
    return F.call_function("translate", c, old, new)


def edifact_segments(text: Column) -> Column:
    """SRC11: segments as arrays of elements as arrays of components, release-aware."""
    una = F.startswith(text, F.lit("UNA")) & (F.length(text) >= 9)
    marks = F.when(una, F.concat(F.substring(text, 7, 1), F.substring(text, 4, 2), F.substring(text, 9, 1))).otherwise(F.lit("?:+'"))
    body = F.regexp_replace(F.when(una, F.substring(text, 10, 1 << 30)).otherwise(text), r"[\r\n]", "")

    def split(m):
        release = F.substring(m, 1, 1)
        held = body
        for i in range(4):
            held = F.replace(held, F.concat(release, F.substring(m, i + 1, 1)), F.lit(_HELD[i]))
        held = F.replace(held, release, F.lit(""))
        cut = _translate(held, F.substring(m, 2, 3), F.lit(_COMP + _ELEM + _TERM))
        part = lambda c: T.strip(_translate(c, F.lit(_HELD), m))
        segs = F.filter(F.split(cut, _TERM), lambda s: s != "")
        return F.transform(segs, lambda s: F.transform(F.split(s, _ELEM), lambda e: F.transform(F.split(e, _COMP), part)))

    return T.let(marks, split)


def _comp(seg: Column, e: int, c: int = 0) -> Column:
    return F.coalesce(F.get(F.get(seg, e), c), F.lit(""))


def _mass(tokens: Column) -> Column:
    """Kilograms from unit and number tokens in any order."""
    up = F.transform(tokens, F.upper)
    unit = F.get(F.filter(up, lambda x: x.isin(list(rules.UNIT_TO_KG))), 0)
    num = F.get(F.filter(up, lambda x: x.rlike(r"^-?[\d.,]+$")), 0)
    return F.replace(num, F.lit(","), F.lit("")).try_cast("double") * T.unit_factor(unit)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def edifact_lines(text: Column) -> Column:
    """SRC11: an EDIFACT message as the label/value lines the extractor reads."""
    def line(seg):
        tag, q1 = F.upper(_comp(seg, 0)), F.upper(_comp(seg, 1))
        row = lambda label, v: F.when((v != "") & label.isNotNull(), F.array(F.concat(label, F.lit(" | "), v)))
        joined = F.filter(F.transform(F.slice(seg, 4, F.size(seg)), lambda e: F.array_join(F.filter(e, lambda x: x != ""), " ")), lambda x: x != "")
        party = _lookup(rules.EDIFACT_PARTIES, q1)
        name = F.coalesce(F.get(joined, 0), _comp(seg, 2))
        address = F.array_join(F.filter(F.slice(joined, 2, F.size(joined)), lambda x: x != name), " ")
        party_rows = F.when(party.isNotNull() & (name != ""), F.filter(F.array(F.concat(party, F.lit(" | "), name), address), lambda x: x != ""))
        kg = _mass(F.flatten(F.slice(seg, 4, F.size(seg))))
        weigh = (q1 == "WT") | F.upper(_comp(seg, 2)).isin(rules.WEIGHT_DIMENSIONS)
        free = F.filter(F.transform(F.slice(seg, 4, F.size(seg)), lambda e: T.squeeze(F.array_join(F.filter(e, lambda x: x != ""), ":"))),
                        lambda x: (F.length(x) >= 3) & x.rlike(r"\p{L}"))
        return (
            F.when(tag == "NAD", party_rows).when(tag == "LOC", row(_lookup(rules.EDIFACT_PLACES, q1), T.place(F.get(seg, 2))))
            .when((tag == "MEA") & weigh & kg.isNotNull(), F.array(F.concat(F.lit("Gross Weight (KG) | "), F.format_number(kg, 2), F.lit(" KG"))))
            .when(tag == "DTM", row(_lookup(rules.EDI_DATES, q1), T.edi_date(_comp(seg, 1, 1), _comp(seg, 1, 2)))).when(tag == "FTX", free)
        )

    def message(segs):
        boxes = F.size(F.filter(segs, lambda s: (F.upper(_comp(s, 0)) == "EQD") & (F.upper(_comp(s, 1)) == "CN")))
        packs = F.get(F.filter(F.transform(F.filter(segs, lambda s: F.upper(_comp(s, 0)) == "GID"), lambda s: _comp(s, 2)), lambda x: x != ""), 0)
        count = F.when(boxes > 0, boxes.cast("string")).otherwise(packs)
        rows = F.flatten(F.filter(F.transform(segs, line), lambda x: x.isNotNull()))
        return F.array_join(F.concat(rows, F.array_compact(F.array(F.concat(F.lit("Container Count | "), count)))), "\n")

    return T.let(edifact_segments(text), message)


def x12_segments(text: Column) -> Column:
    """SRC12: segments as arrays of elements; delimiters from the header, else from the first tags."""
    flat = F.regexp_replace(text, r"[\r\n]", "")
    isa = F.startswith(text, F.lit("ISA")) & (F.length(text) > 106)
    elem = F.when(isa, F.substring(text, 4, 1)).otherwise(F.coalesce(T.blank_to_null(F.regexp_extract(flat, r"^[A-Z0-9]{2,3}([^\sA-Za-z0-9])", 1)), F.lit("*")))
    term = F.when(isa, F.substring(text, 106, 1)).otherwise(F.coalesce(T.blank_to_null(F.regexp_extract(flat, r"([^\sA-Za-z0-9])[A-Z0-9]{2,3}\*", 1)), F.lit("~")))
    term = T.let(term, lambda x: F.when(x == elem, "~").otherwise(x))

    def split(d):
        body = F.when(F.contains(text, d["t"]), _translate(flat, F.concat(d["t"], d["e"]), F.lit(_TERM + _ELEM)))
        lines = _translate(F.regexp_replace(text, r"[\r\n]+", _TERM), d["e"], F.lit(_ELEM))
        segs = F.transform(F.split(F.coalesce(body, lines), _TERM), lambda s: F.transform(F.split(s, _ELEM), T.strip))
        return F.filter(segs, lambda s: F.get(s, 0) != "")

    return T.let(F.struct(elem.alias("e"), term.alias("t")), split)


def x12_lines(text: Column) -> Column:
    """SRC12: an X12 message as label/value lines; address segments follow their party."""
    at = lambda s, i: F.coalesce(F.get(s, i), F.lit(""))

    def line(s):
        tag, q = F.upper(at(s, 0)), F.upper(at(s, 1))
        row = lambda label, v: F.when(label.isNotNull() & (v != ""), F.concat(label, F.lit(" | "), v))
        kg = F.coalesce(_mass(F.slice(s, 4, F.size(s))), F.replace(F.get(F.filter(F.slice(s, 4, F.size(s)), lambda x: x.rlike(r"^-?[\d.,]+$")), 0), F.lit(","), F.lit("")).try_cast("double"))
        fmt = F.coalesce(T.blank_to_null(at(s, 3)), F.when(F.length(F.regexp_replace(at(s, 2), r"\D", "")) >= 8, "102").otherwise(""))
        return (
            F.when(tag == "N1", row(_lookup(rules.X12_PARTIES, q), at(s, 2))).when(tag == "N3", at(s, 1))
            .when(tag == "N4", F.array_join(F.filter(F.slice(s, 2, F.size(s)), lambda x: x != ""), ", "))
            .when((tag == "MEA") & q.isin("WT", "AAE") & F.upper(at(s, 2)).isin(rules.WEIGHT_DIMENSIONS) & kg.isNotNull(),
                  F.concat(F.lit("Gross Weight (KG) | "), F.format_number(kg, 2), F.lit(" KG")))
            .when(tag == "DTM", row(_lookup(rules.EDI_DATES, q), T.edi_date(at(s, 2), fmt)))
            .when(tag == "NTE", T.blank_to_null(T.squeeze(at(s, 2)))).when(tag == "R4", row(_lookup(rules.X12_PORTS, at(s, 1)), T.place(F.slice(s, 4, F.size(s)))))
        )

    def message(segs):
        boxes = F.size(F.filter(segs, lambda s: F.upper(at(s, 0)) == "N7"))
        packs = F.get(F.filter(F.transform(F.filter(segs, lambda s: F.upper(at(s, 0)) == "TD1"), lambda s: at(s, 2)), lambda x: x.rlike(r"^-?[\d.,]+$")), 0)
        count = F.when(boxes > 0, boxes.cast("string")).otherwise(packs)
        rows = F.filter(F.transform(segs, line), lambda x: x.isNotNull() & (x != ""))
        return F.array_join(F.concat(rows, F.array_compact(F.array(F.concat(F.lit("Container Count | "), count)))), "\n")

    return T.let(x12_segments(text), message)
