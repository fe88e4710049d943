"""Label/value extraction from document texts (EXT1-EXT13).

One row per document goes in and one row per document comes out: lines live in an
array column and are handled by higher-order functions, so extraction needs no
shuffle and the raw text never leaves the task that read it. Only the nine small
field values travel on.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import text as T

ORD = {f: i for i, f in enumerate(rules.ALL_FIELDS)}
ALTERNATION = {f: "|".join(ps) for f, ps in rules.LABELS.items()}
ANY_LABEL = "(?i)" + "|".join(ALTERNATION.values())
_EVERY = "|".join(ALTERNATION.values())


def _spaced(pattern: str) -> str:
    """The pattern on a line as it stands: any run of white space where the squeezed line has a blank."""
    return pattern.replace(r"\s", "\0").replace(" ", f"{T.SHORT_WS}+").replace("\0", T.SHORT_WS)


#: The first label of a line, and of which field a label is; both need no squeezed line.
LABEL = "(?i)" + T.grouped([_spaced(p) for ps in rules.LABELS.values() for p in ps])
FIELD_LABEL = {f: f"(?i)^(?:{_spaced(p)})" for f, p in ALTERNATION.items()}
#: The fields, in their order, that have a label with this first letter.
FIELDS_BY_LETTER = {c: [f for f, ps in rules.LABELS.items() if any(p.removeprefix(r"\b")[0].lower() == c for p in ps)] for c in T.letters(rules.LABELS.values())}
#: By letter from a on: the field's ordinal where all labels with this first letter are of one field, else a negative number that tells the letter.
BY_LETTER = [None if c not in FIELDS_BY_LETTER else ORD[FIELDS_BY_LETTER[c][0]] if len(FIELDS_BY_LETTER[c]) == 1 else -1 - i
             for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
#: What may stand between a label and its separator: a bracket, a unit, name or address, or a second label behind a slash.
_LABEL_TAIL = (rf"\.?{T.WS}*(?:(?:\([^)]*\)|(?:in{T.WS}+)?(?:kgs?|mts?)\b|(?:(?:and|&){T.WS}*)?(?:name|address|details?)\b"
               rf"|/{T.WS}*(?:\p{{L}}+{T.WS}+){{0,2}}(?:{_EVERY})){T.WS}*)*[:：|\t]")


def _opening(pattern: str) -> str:
    """A label on word bounds that a separator follows; "same as consignee" refers to a field and opens none."""
    return rf"(?<![\p{{L}}\p{{N}}])(?<!\bas )(?:{pattern})(?![\p{{L}}\p{{N}}])(?={_LABEL_TAIL})"


_ANY = T.grouped([p for ps in rules.LABELS.values() for p in ps])
ANY_OPENING = "(?i)" + _opening(_ANY)
TWO_LABELS = rf"{ANY_OPENING}.*?[:：|\t].*?{_opening(_ANY)}"
#: The same place without its text, and the label of one field at the start of a rest that begins at such a place.
OPENING_PLACE = rf"(?i)(?<![\p{{L}}\p{{N}}])(?<!\bas )(?=(?:{_ANY})(?![\p{{L}}\p{{N}}]){_LABEL_TAIL})"
OPENING_OF = {f: rf"(?i)^(?:{p})(?![\p{{L}}\p{{N}}])(?={_LABEL_TAIL})" for f, p in ALTERNATION.items()}
#: What every such line has; linear, and false for nearly all lines, so the search for labels is seldom begun.
TWO_SEPARATORS = r"[:：|\t][^:：|\t\n]*+[:：|\t]"
LABEL_LINE = r"^[^:|]*[:|]"

FIELDS_TYPE = (
    "struct<shipper:string,consignee:string,notify_party:string,port_of_loading:string,"
    "port_of_discharge:string,container_count:bigint,gross_weight_kg:double,etd:string,eta:string>"
)


def _broken(text: Column) -> Column:
    """A text with wide blank runs shortened to two and one kind of line break."""
    return T.plain_breaks(F.regexp_replace(text, r"[ \t]{2,}", "  "))


def lines_of(text: Column) -> Column:
    """EXT1: physical lines with wide blank runs shortened to two."""
    return F.split(_broken(text), "\n")


def _openings(line: Column) -> Column:
    """Every place of a line where a label opens, by place and field, with its end: one pass finds the places of all fields."""
    pieces = F.split(F.regexp_replace(line, OPENING_PLACE, "\n"), "\n")  # a line has no newline of its own
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))
    step = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["places"], F.array(a["at"])).alias("places"))
    places = F.aggregate(pieces, zero, step, lambda a: F.slice(a["places"], 2, F.size(a["places"])))

    def hit(at, rest, f):
        return F.struct(at.alias("at"), F.lit(f).alias("field"), (at + F.length(F.regexp_extract(rest, OPENING_OF[f], 0))).alias("upto"))

    def at_place(at):
        def of(rest):
            def by(letter):
                out = F
                for c, fields in FIELDS_BY_LETTER.items():
                    out = out.when(letter.isin(ord(c), ord(c.upper())), F.array(*[hit(at, rest, f) for f in sorted(fields)]))
                return out

            return T.let(F.ascii(rest), by)

        return F.filter(T.let(line.substr(at + 1, F.length(line)), of), lambda h: h["upto"] > at)

    return F.flatten(F.transform(places, at_place))


def split_long_line(line: Column) -> Column:
    """EXT3: a line that lost its breaks becomes one piece per field label.

    Labels are taken left to right; a label opens a piece only on word bounds and
    with a separator of its own, when a separator also stands between it and the
    previous one, and each field opens one piece. A label inside another one of its
    field opens none.
    """
    zero = F.struct(
        F.lit(None).cast("int").alias("prev"),
        F.array().cast("array<string>").alias("seen"),
        F.array().cast("array<int>").alias("cuts"),
        F.array().cast("array<struct<at:int,field:string,upto:int>>").alias("hits"),
    )

    def step(a, h):
        between = line.substr(a["prev"] + 1, h["at"] - a["prev"])
        inside = F.exists(a["hits"], lambda o: (o["field"] == h["field"]) & (o["upto"] > h["at"]))
        fresh = ~F.array_contains(a["seen"], h["field"]) & (
            a["prev"].isNull() | between.rlike(r"[:：|\t]")) & ~inside
        hits = F.when(inside, a["hits"]).otherwise(F.concat(a["hits"], F.array(h))).alias("hits")
        grown = F.struct(h["at"].alias("prev"), F.concat(a["seen"], F.array(h["field"])).alias("seen"),
                         F.concat(a["cuts"], F.array(h["at"])).alias("cuts"), hits)
        return F.when(fresh, grown).otherwise(F.struct(a["prev"].alias("prev"), a["seen"].alias("seen"), a["cuts"].alias("cuts"), hits))

    cuts = F.aggregate(_openings(line), zero, step, lambda a: a["cuts"])
    def pieces(bounds):
        return F.transform(bounds, lambda b, i: line.substr(b + 1, F.coalesce(F.get(bounds, i + 1), F.length(line)) - b))

    # A cut at zero keeps the preamble; the duplicate is dropped when a label is first.
    return T.let(cuts, lambda c: F.when(F.size(c) >= 2, T.let(
        F.array_distinct(F.concat(F.array(F.lit(0)), c)), pieces)).otherwise(F.array(line)))


def segments(text: Column) -> Column:
    """Lines; one that holds two labels, each with its separator, is split."""
    def one(l):
        return F.when(l.rlike(TWO_SEPARATORS) & l.rlike(TWO_LABELS), split_long_line(l)).otherwise(F.array(l))

    # The whole text tells in one search whether any of its lines has two separators.
    return T.let(_broken(text), lambda t: F.when(
        t.rlike(TWO_SEPARATORS), F.flatten(F.transform(F.split(t, "\n"), one))).otherwise(F.split(t, "\n")))


def label_of(line: Column) -> Column:
    """EXT4: ordinal of the field whose label starts first; null without a label.

    Alternation is leftmost-first, so one pass over the line finds the earliest
    label, ties going to the field listed first. The first letter of the short matched
    text leaves one to three fields, and the text tells which of them it was.
    """
    def among(label, fields):
        out = F.lit(ORD[fields[-1]])  # a label is of one of them
        for f in reversed(fields[:-1]):
            out = F.when(label.rlike(FIELD_LABEL[f]), ORD[f]).otherwise(out)
        return out

    def which(label):
        def by(found):
            out = F.when(found >= 0, found)
            for c, fields in FIELDS_BY_LETTER.items():
                if len(fields) > 1:
                    out = out.when(found == BY_LETTER[ord(c) - ord("a")], among(label, fields))
            return out

        # Small and capital letters differ in one bit. Without a label there is no letter and no element.
        return T.let(F.get(F.array(*[F.lit(n) for n in BY_LETTER]), F.ascii(label).bitwiseOR(32) - ord("a")), by)

    return T.let(F.regexp_extract(line, LABEL, 0), which)


def inline_value(line: Column) -> Column:
    """EXT5: text after the label: table cell, else after a colon, else after a dash."""
    cell = rf"(?s)^(.*?)(?:{T.SHORT_WS}*\||\t+)(.*)$"
    dash = rf"(?s)^[^:：]*?[\-–]{T.SHORT_WS}+(.*)$"
    in_cell = (F.contains(line, F.lit("|")) | F.contains(line, F.lit("\t"))) & (T.bare(F.regexp_extract(line, cell, 1)) != "")
    wide = F.contains(line, F.lit("："))
    colon = F.when(wide, F.length(F.regexp_extract(line, r"(?s)^[^:：]*", 0)) + 1).otherwise(F.instr(line, ":"))
    return F.coalesce(
        F.when(in_cell, T.blank_to_null(T.bare(F.regexp_extract(line, cell, 2)))),
        T.let(colon, lambda p: F.when(p > 0, T.bare(F.substring(line, p + 1, 2**31 - 1)))),
        T.bare(F.regexp_extract(line, dash, 1)),
    )


def typed_value(ordinal: Column, value: Column) -> Column:
    """Field-specific cleaning of a stripped text; every value as text, EXT9 placeholders dropped."""
    return T.blank_to_null(
        F.when(ordinal < 3, T.name_value(value))
        .when(ordinal < 5, T.port_value(value))
        .when(ordinal == 5, T.container_count(value).cast("string"))
        .when(ordinal == 6, T.weight_kg(value).cast("string"))
        .otherwise(T.iso_date(value))
    )


def sources_of(lines: Column) -> Column:
    """EXT4-EXT6: every labelled line as its number from 1, its field's ordinal and the text its value is read from.

    Blank lines carry nothing, so the value below a label is on the next line that is left.
    """
    def row(i, ordinal, src):
        return F.struct((i + 1).alias("ln"), ordinal.alias("ord"), src.alias("src"))

    return T.let(lines, lambda ls: _labelled(ls, row))


def _labelled(lines: Column, row) -> Column:
    """One row per labelled line, made from the line's index, its ordinal and its source, each worked out once."""
    def below(ordinal, i):
        rest = F.filter(F.slice(lines, i + 2, F.size(lines)), lambda l: l.rlike(T.INK))  # looked at only where the label's line ends
        return T.let(F.when(ordinal < 5, T.bare(F.get(rest, 0))), lambda n: F.when(~(n.rlike(LABEL_LINE) & n.rlike(LABEL)), n))

    def one(l, i):
        def of(ordinal):
            src = F.coalesce(T.blank_to_null(inline_value(l)), below(ordinal, i))
            return F.when(ordinal.isNotNull(), row(i, ordinal, src))

        return T.let(label_of(l), of)

    return F.filter(F.transform(lines, one), lambda x: x.isNotNull())


def fields_of(text: Column) -> Column:
    """EXT1-EXT9 as one expression: the fields struct of a readable text (else nulls)."""
    def row(i, ordinal, src):
        return F.struct(ordinal.alias("ord"), T.let(src, lambda s: typed_value(ordinal, s)).alias("v"))

    def pick(got, ords, f):
        v = F.get(got, F.array_position(ords, F.lit(ORD[f])).cast("int") - 1)["v"]
        kind = {"container_count": "bigint", "gross_weight_kg": "double"}.get(f)
        return (v.try_cast(kind) if kind else v).alias(f)

    got = F.filter(T.let(segments(text), lambda lines: _labelled(lines, row)), lambda x: x["v"].isNotNull())
    return T.let(got, lambda g: T.let(g["ord"], lambda ords: F.struct(*[pick(g, ords, f) for f in rules.ALL_FIELDS])))


# ------------------------------------------------- the same over a text as a whole
# Lambdas are interpreted, searches in a projection are compiled. Marks written into the text tell the field of a place:
# one per field and one that ends them; what stands behind a field's mark is empty unless the place is of this field.
MARK = [rf"\x{0x0E + i:02x}" for i in range(len(rules.ALL_FIELDS) + 1)]
_ANY_MARK = f"[{MARK[0]}-{MARK[-1]}]"
_PLAIN = rf"[^{MARK[0]}-{MARK[-1]}\n]"
_LINE_WS, _LINE_INK = r"[\t\x1f\p{Z}]", r"[^\s\x1f\p{Z}]"  # inside a line, where all breaks are plain


def _in_line(pattern: str) -> str:
    """A pattern made for single lines that stays inside a line of a text."""
    for ws in (T.WS, T.SHORT_WS):
        pattern = pattern.replace(ws, _LINE_WS)
    return pattern.replace("[^)]", r"[^)\n]").replace(r"\s", r"[ \t]")


def _told(labels: dict[str, list[str]]) -> tuple[str, str]:
    """All labels as one alternation that captures a label's first letter in a group of its field, and the marks with these groups."""
    by_letter, groups, n = {}, {f: [] for f in rules.ALL_FIELDS}, 0
    for f, ps in labels.items():
        for p in ps:
            letter = p.removeprefix(r"\b")[0].lower()
            by_letter.setdefault(letter, {}).setdefault(f, []).append(p)
    arms = []
    for letter, fields in by_letter.items():
        ways = []
        for f, ps in fields.items():
            n += 1
            groups[f].append(n)
            ways.append(rf"({letter})(?:{T.grouped(ps)[len(letter) + len('(?:'):-1]})")
        arms.append(ways[0] if len(ways) == 1 else f"(?={letter})(?:{'|'.join(ways)})")
    marks = "".join(chr(0x0E + i) + "".join(f"${g}" for g in groups[f]) for i, f in enumerate(rules.ALL_FIELDS)) + chr(0x0E + len(rules.ALL_FIELDS))
    return f"(?=[{''.join(by_letter)}])(?:{'|'.join(arms)})", marks


_FIRST, LINE_MARKS = _told({f: [_in_line(_spaced(p)) for p in ps] for f, ps in rules.LABELS.items()})
#: The start of a line that has a label; the first one tells the field.
LABELLED = rf"(?dim)^(?=[^\n]*?{_FIRST})"


def _openings_told() -> tuple[str, str]:
    """A label that opens a piece, with a group for each field whose labels are found here, and the marks with these groups."""
    arms, groups, n = [], {f: [] for f in rules.ALL_FIELDS}, 1
    for letter, fields in FIELDS_BY_LETTER.items():
        own = {f: T.grouped([_in_line(p) for p in rules.LABELS[f] if p.removeprefix(r"\b")[0].lower() == letter]) for f in sorted(fields, key=ORD.get)}
        for f in own:
            n += 1
            groups[f].append(n)
        arms.append(f"(?=({letter}))" if len(own) == 1 else f"(?={letter})" + "".join(f"(?:(?=({p}))|)" for p in own.values()))
    marks = "".join(chr(0x0E + i) + "".join(f"${g}" for g in groups[f]) for i, f in enumerate(rules.ALL_FIELDS)) + chr(0x0E + len(rules.ALL_FIELDS))
    place = rf"(?=[{''.join(FIELDS_BY_LETTER)}])(?<![\p{{L}}\p{{N}}])(?<!\bas )"
    # That a label opens here is known before a field's group is set: one that is set in a look ahead would stay until the next place.
    return rf"(?di){place}(?=({_in_line(_ANY)})(?![\p{{L}}\p{{N}}]){_in_line(_LABEL_TAIL)})(?:{'|'.join(arms)})\1", marks + "$0"


#: Places inside of such a label are of its own field.
OPENING, OPENING_MARKS = _openings_told()
_OPEN, _CLOSE = MARK[0], MARK[-1]
#: The marks before a place's first label, which tell its field.
PLACE_FIELD = rf"{_OPEN}([{MARK[1]}-{MARK[-2]}]*+){_PLAIN}"
FIELD_CODE = ["".join(chr(0x0F + j) for j in range(i)) for i in range(len(rules.ALL_FIELDS))]
#: What every line with two cuts has, seen from its start: a letter, then two separators with a letter between them.
LETTERS_AND_SEPARATORS = r"(?dim)^[^a-z\n]*+[a-z][^:：|\t\n]*+[:：|\t](?:[^a-z:：|\t\n]*+[:：|\t])*+[^a-z:：|\t\n]*+[a-z][^:：|\t\n]*+[:：|\t]"
#: Openings that are all cuts, if no field opens twice in a line: one field at each place, and a separator between two of a line.
PLAIN_OPENINGS = (rf"^[^{_OPEN}]*+(?:{_OPEN}[{MARK[1]}-{MARK[-2]}]*+{_PLAIN}++[{MARK[1]}-{MARK[-2]}]*+{_CLOSE}"
                  rf"(?![^:：|\t\n{_OPEN}]*+{_OPEN})[^{_OPEN}]*+)*+\z")
FIELD_TWICE = rf"([{MARK[0]}-{MARK[-2]}]){_PLAIN}[^\n]*\1{_PLAIN}"
ONE_OPENING = rf"(?dm)^([^\n{_OPEN}]*+){_OPEN}[^{_CLOSE}\n]*+{_CLOSE}([^\n{_OPEN}]*+)$"

_CELL = rf"[\x1f\p{{Z}}]*+[^\s\x1f\p{{Z}}|][^|\t\n]*+(?>\||\t{_LINE_WS}*+\||\t++){_LINE_WS}*+(?=[^\n])"
_LABELLED_LINE = rf"(?d){_OPEN}[^{_CLOSE}\n]++{_CLOSE}"
INLINE_VALUE = rf"{_LABELLED_LINE}(?:(?:{_CELL}|[^:：\n]*+[:：]{_LINE_WS}*+|[^:：\n]*?[\-–]{_LINE_WS}++)([^\n]*{_LINE_INK})?)?"


def _value_below(i: int) -> str:
    """What stands below the first line of a field: the next line with ink, unless it has a label and a separator."""
    line = rf"(?d){MARK[i]}{_PLAIN}[^{_CLOSE}\n]*+{_CLOSE}[^\n]*+"
    return rf"{line}(?:\n(?:{_LINE_WS}*+\n)*+(?:{_OPEN}[^{_CLOSE}\n]*+{_CLOSE}(?![^\n:|]*+[:|])|(?!{_OPEN})){_LINE_WS}*+([^\n]*{_LINE_INK}))?"


def _cut(marked: Column) -> Column:
    """Lines with two openings or more are cut at each of them; a line's only one is left alone."""
    return F.regexp_replace(F.regexp_replace(marked, ONE_OPENING, "$1$2"), rf"{_OPEN}[^{_CLOSE}]*+{_CLOSE}", "\n")


def with_fields(docs: DataFrame, text: str = "text", out: str = "fields") -> DataFrame:
    """Add the fields struct (values as printed, cleaned) to a frame of documents.

    The result is that of :func:`fields_of`. It is found by searches over the whole text in a chain of projections, each of
    which binds what the next one reads several times. A text whose openings are not all cuts is cut by :func:`segments`.
    A text that holds a mark, or whose first line of a field gives no value while a later one may, goes to :func:`fields_of`.
    """
    df = docs if "unreadable" in docs.columns else docs.withColumn("unreadable", T.unreadable(F.col(text)))
    c, n = F.col, range(len(rules.ALL_FIELDS))
    kept = F.when(~c("unreadable"), c(text))
    df = df.withColumn("_broken", _broken(kept))
    df = df.withColumn("_opened", F.when(c("_broken").rlike(LETTERS_AND_SEPARATORS), F.regexp_replace("_broken", F.lit(OPENING), F.lit(OPENING_MARKS))))
    df = df.withColumn("_places", F.regexp_extract_all("_opened", F.lit(PLACE_FIELD), F.lit(1)))
    twice = (F.size("_places") > F.size(F.array_distinct("_places"))) & c("_opened").rlike(FIELD_TWICE)
    df = df.withColumn("_lines", F.when(c("_opened").isNull(), c("_broken")).when(
        ~c("_opened").rlike(PLAIN_OPENINGS) | twice, F.array_join(segments(c("_broken")), "\n")).otherwise(_cut(c("_opened"))))
    df = df.withColumn("_marked", F.regexp_replace("_lines", F.lit(LABELLED), F.lit(LINE_MARKS)))
    df = df.withColumns({"_found": F.regexp_extract_all("_marked", F.lit(PLACE_FIELD), F.lit(1)), "_inline": F.regexp_extract_all("_marked", F.lit(INLINE_VALUE), F.lit(1))})

    def source(i):
        def of(x):
            return F.when(x == "", F.regexp_extract("_marked", _value_below(i), 1)).otherwise(x) if i < 5 else x

        return T.let(F.array_position("_found", F.lit(FIELD_CODE[i])).cast("int"), lambda at: T.let(F.get("_inline", at - 1), of))

    # The bindings keep this step and the next ones out of one long generated method, which the JVM would not compile.
    df = df.withColumns({f"_src{i}": source(i) for i in n})
    value = lambda i: T.container_count if i == 5 else T.weight_kg if i == 6 else T.iso_date if i > 6 else T.name_value if i < 3 else T.port_value
    df = df.withColumns({f"_value{i}": value(i)(c(f"_src{i}")) if i > 4 else F.nullif(value(i)(c(f"_src{i}")), F.lit("")) for i in n})
    other = c("_broken").rlike(_ANY_MARK)
    for i in n:  # the first line of a field has no value, and there is another one
        other = other | c(f"_value{i}").isNull() & (F.size("_found") - F.size(F.array_remove("_found", FIELD_CODE[i])) > 1)
    df = df.withColumn(out, F.when(other, fields_of(kept)).otherwise(F.struct(*[c(f"_value{i}").alias(f) for i, f in enumerate(rules.ALL_FIELDS)])))
    df = df.drop("_broken", "_opened", "_places", "_lines", "_marked", "_found", "_inline", *[f"_{x}{i}" for x in ("src", "value") for i in n])
    return df if "unreadable" in docs.columns else df.drop("unreadable")


def missing_fields(fields: Column) -> Column:
    """EXT8: compared fields without a value, in canonical order."""
    return F.array_compact(F.array(*[
        F.when(fields[f].isNull(), F.lit(f)) for f in rules.COMPARED_FIELDS]))


def field_yield(fields: Column) -> Column:
    """EXT10: how many of the seven compared fields were read."""
    return F.lit(len(rules.COMPARED_FIELDS)) - F.size(missing_fields(fields))


def normal_value(field: str, value: Column) -> Column:
    """The comparable form of one field."""
    return T.norm_name(value, cut=False) if field in rules.NAME_FIELDS else T.port_parts(value) if field in rules.PORT_FIELDS else value


def normalised(fields: Column) -> Column:
    """The comparable form of each field, computed once per document."""
    return F.struct(*[normal_value(f, fields[f]).alias(f) for f in (*rules.NAME_FIELDS, *rules.PORT_FIELDS, "container_count", "gross_weight_kg", "etd", "eta")])


def best_reading(candidates: DataFrame, keys: list[str], rung: str = "rung") -> DataFrame:
    """EXT10: of several texts of a document keep the richest, earliest rung on ties.

    A reader is only tried when the one before it found fewer than four fields, so
    later rungs count only behind such a reading.
    """
    found = candidates.filter(F.col("text").isNotNull() & (F.length("text") > 0))
    scored = with_fields(found).select(*keys, F.col(rung).alias("r"), field_yield(F.col("fields")).alias("y"))
    # One entry per reader, of which there are a handful; the texts stay behind.
    tried = scored.groupBy(*keys).agg(F.collect_list(F.struct("r", "y")).alias("tried"))
    good = F.array_min(F.transform(F.filter("tried", lambda x: x["y"] >= 4), lambda x: x["r"]))
    usable = F.filter("tried", lambda x: good.isNull() | (x["r"] <= good))
    best = F.array_max(F.transform(usable, lambda x: F.struct(x["y"].alias("yield"), (-x["r"]).alias("neg"))))
    won = tried.select(*keys, best.alias("b")).select(*keys, (-F.col("b.neg")).alias(rung), F.col("b.yield").alias("yield"))
    return found.select(*keys, rung, "text").join(won, [*keys, rung]).select(*keys, "text", rung, "yield")


def backfill(primary: Column, secondary: Column) -> Column:
    """EXT11: primary values win, the secondary reading fills gaps."""
    return F.struct(*[F.coalesce(primary[f], secondary[f]).alias(f) for f in rules.ALL_FIELDS])


def invoice_fields(text: Column) -> Column:
    """EXT13: number, total and currency of a commercial invoice."""
    return F.struct(
        T.blank_to_null(F.regexp_extract(text, rules.INVOICE_NUMBER, 1)).alias("invoice_number"),
        T.blank_to_null(F.regexp_replace(F.regexp_extract(text, rules.INVOICE_TOTAL, 1), ",", "")).alias("total_amount"),
        T.blank_to_null(F.regexp_extract(text, rules.CURRENCY, 1)).alias("currency"),
    )
