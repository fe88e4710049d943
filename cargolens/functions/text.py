"""Column functions: whitespace, names, ports, counts, weights, dates, addresses.

Everything is a composition of built-in functions, so it stays inside the JVM.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .. import rules

# Unicode white space spelled out: Java's \s is ASCII only. Latin characters come one by one and the rest behind a range,
# so a class answers a plain letter with one look at a table; a class of many ranges asks each of them.
_FAR_WS = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
_ODD = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0" + _FAR_WS
WS = f"[ {_ODD}]"
ODD_WS = f"[{_ODD}]"
#: The same class in few characters. Spark compares the text of an extracting pattern at each call, so long ones cost by their length.
SHORT_WS = r"[\s\x85\x1c-\x1f\p{Z}]"
INK = f"(?!{WS})."
WS_CHARS = " \t\n\x0b\f\r" + "".join(map(chr, [
    *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Everything that ends a line, apart from the plain newline.
ODD_BREAK = r"[\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}-\x{2029}](?:(?<=\r)\n)?"
#: The cut is tried only where one of its alternatives can begin.
ADDRESS_CUT = rules.ADDRESS_CUT.replace(r"\s*(?:", r"\s*(?=[|;,octfe])(?:", 1)


def grouped(patterns: list[str], fold: bool = True) -> str:
    """An alternation that finds the same matches and asks for each first letter once; ``fold`` where case is ignored.

    Alternatives that can match at one place begin with one letter, so they keep their order.
    """
    by_letter: dict[str, list[str]] = {}
    for p in patterns:
        bound, letter, rest = re.fullmatch(r"(\\b)?([A-Za-z])((?![?*+{|]).+)", p).groups()
        by_letter.setdefault(letter.lower() if fold else letter, []).append((rf"(?<=\b{letter})" if bound else "") + rest)
    return "|".join(f"{letter}(?:{'|'.join(rests)})" for letter, rests in by_letter.items())


#: The legal-form words, each first letter asked for once.
LEGAL_SUFFIXES = rules.LEGAL_SUFFIXES.replace(rules.LEGAL_SUFFIXES[3:-6], grouped(rules.LEGAL_SUFFIXES[3:-6].split("|"), fold=False))


def letters(tables) -> list[str]:
    """The first letters of all patterns of some lists, in the order of their first use."""
    return list(dict.fromkeys(p.removeprefix(r"\b")[0].lower() for ps in tables for p in ps))


def let(value: Column, body) -> Column:
    """Evaluate an expression once and use it several times.

    Inside a lambda Catalyst shares no common subexpressions, so a value that is read
    twice would be computed twice. A fold over nothing binds it to a variable: its last
    step reads the start value. Taking an element of a one-element transform would do the
    same, but asks at each row for the type and nullability of the whole body.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


def strip(c: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.trim(c, F.lit(WS_CHARS))


def bare(c: Column) -> Column:
    """The same as :func:`strip`, for use inside a lambda: the list of characters is asked only where another one than a blank stands at an end."""
    return let(F.trim(c), lambda x: F.when(x.rlike(rf"(?s)^(?:{ODD_WS}|.*+(?<={ODD_WS}))"), strip(x)).otherwise(x))


def one_blank(c: Column) -> Column:
    """Each white-space run becomes one blank; single plain blanks are left alone."""
    return F.regexp_replace(c, rf"{WS}(?:{WS}+|(?<! ))", " ")


def squeeze(c: Column) -> Column:
    """NRM1: each white-space run becomes one blank, ends trimmed."""
    return F.trim(one_blank(c))


def plain_breaks(c: Column) -> Column:
    """Every line break becomes a plain newline."""
    return F.regexp_replace(c, ODD_BREAK, "\n")


def split_lines(c: Column) -> Column:
    """Physical lines. The split itself is on one character, which needs no regex."""
    return F.split(plain_breaks(c), "\n")


def drop_spaces(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WS}+", "")


def blank_to_null(c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", x))


def contains_any(c: Column, words: list[str]) -> Column:
    """True when any literal occurs in the text (one alternation, one scan)."""
    return c.rlike("|".join(_quote(w) for w in words))


def _quote(word: str) -> str:
    return r"\Q" + word + r"\E"


def count_contained(c: Column, words: list[str]) -> Column:
    """Number of distinct literals that occur in the text."""
    hits = [F.contains(c, F.lit(w)).cast("int") for w in words]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total


# ------------------------------------------------------------- names and ports
def cut_address(c: Column) -> Column:
    return bare(F.regexp_replace(c, ADDRESS_CUT, ""))


def is_placeholder(c: Column) -> Column:
    """EXT9: text that stands for an unfilled field."""
    return squeeze(c).rlike(rules.PLACEHOLDER)


def value_or_null(c: Column) -> Column:
    """A squeezed value, null when it is blank or a placeholder."""
    return let(c, lambda x: F.when((x != "") & ~x.rlike(rules.PLACEHOLDER), x))


_WIDE = rf"{WS}(?:{WS}|(?<! ))"
_PORT_UNTIDY = rf"{rules.TRAILING_LABELS}|{_WIDE}"
_NAME_UNTIDY = rf"{_PORT_UNTIDY}|(?=[|;,octfe]){ADDRESS_CUT[len('(?i)'):]}"


# What neither needs tidying nor can be a placeholder, in its own letters or as capitals, is found by one search.
_PLACEHOLDER_OR_FAR = rf"{rules.PLACEHOLDER}|[^\x00-\x7f]"
_NAME_CARE, _PORT_CARE = rf"{_NAME_UNTIDY}|{_PLACEHOLDER_OR_FAR}", rf"{_PORT_UNTIDY}|{_PLACEHOLDER_OR_FAR}"


def name_value(s: Column) -> Column:
    """The cleaned name of a stripped text, null for a placeholder."""
    return F.when(s.rlike(_NAME_CARE), value_or_null(clean_name(s))).otherwise(F.upper(s))


def port_value(s: Column) -> Column:
    """The cleaned port of a stripped text, null for a placeholder."""
    return F.when(s.rlike(_PORT_CARE), value_or_null(clean_port(s))).otherwise(F.upper(s))


def clean_name(c: Column) -> Column:
    """NRM3: printed company name: label remnants, address and wide gaps removed; a value with nothing to remove is searched once."""
    def tidied(s):
        v = F.regexp_replace(s, rules.TRAILING_LABELS, "")
        v = F.regexp_replace(v, r"(?s)[ \t\xa0]{3,}.*", "")
        return F.trim(F.regexp_replace(one_blank(v), ADDRESS_CUT, ""))

    return F.upper(let(bare(c), lambda s: F.when(s.rlike(_NAME_UNTIDY), tidied(s)).otherwise(s)))


def clean_port(c: Column) -> Column:
    def tidied(s):
        return squeeze(F.regexp_replace(s, rules.TRAILING_LABELS, ""))

    return F.upper(let(bare(c), lambda s: F.when(s.rlike(_PORT_UNTIDY), tidied(s)).otherwise(s)))


def norm_name(c: Column, cut: bool = True) -> Column:
    """NRM2: comparable company name; legal-form words dropped when enough is left.

    ``cut=False`` skips the address cut for values :func:`clean_name` has cut already.
    """
    head = F.upper(cut_address(c) if cut else c)
    # Only letters, digits and plain blanks are left.
    return let(F.trim(F.regexp_replace(head, r"[^A-Z0-9]+", " ")), lambda b: let(
        F.trim(F.regexp_replace(F.regexp_replace(b, LEGAL_SUFFIXES, " "), " {2,}", " ")),
        lambda bare: F.when(F.length(bare) >= 4, bare).otherwise(b)))


def port_code(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(F.upper(c), r"\(([A-Z]{5})\)", 1))


def port_name(c: Column) -> Column:
    return norm_name(F.regexp_replace(bare(F.upper(c)), r"\([A-Z]{5}\)", " "))


def port_parts(c: Column) -> Column:
    """NRM4: struct of comparable name, five-letter code, and both as one value."""
    parts = F.struct(port_name(c).alias("name"), port_code(c).alias("code"))
    return F.when(c.isNotNull(), let(parts, lambda p: F.struct(
        p["name"].alias("name"), p["code"].alias("code"), F.trim(F.concat_ws(" ", p["name"], p["code"])).alias("value"))))


def norm_port(c: Column) -> Column:
    return port_parts(c)["value"]


# ---------------------------------------------------------- counts and weights
def _number(digits: Column, kind: str) -> Column:
    """The number an extracted text holds; an empty one is no number and is not handed to the cast, which would raise and catch."""
    return let(digits, lambda d: F.when(d != "", d.try_cast(kind)))


def container_count(c: Column) -> Column:
    """NRM5: number of containers; a container number is not a count."""
    def plain(bare):
        return _number(F.regexp_extract(bare, r"(\d+)", 1), "bigint")

    def compound(v):
        parts = F.filter(F.split(v, rules.CONTAINER_JOIN), lambda p: strip(p) != "")
        specs = F.transform(parts, lambda p: _number(F.regexp_extract(drop_spaces(p), rules.CONTAINER_SPEC, 1), "bigint"))
        total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
        return let(specs, lambda x: F.when((F.size(x) >= 2) & F.forall(x, lambda n: n.isNotNull()), total(x)))

    number = r"^[A-Z]{4}\d{7}$"
    joined = r"(?i)[+&/,]|\band\b|\bplus\b"  # what CONTAINER_JOIN finds, without the space around it
    return let(c, lambda v: let(F.regexp_replace(v, rf"[,{WS[1:-1]}]+", ""), lambda b: F.when(
        ~(b.rlike(r"\d{7}$") & F.upper(b).rlike(number)),
        F.coalesce(F.when(v.rlike(joined), compound(v)), plain(b)))))


def weight_kg(c: Column) -> Column:
    """NRM6: leading number with its unit, in kilograms; else the first weight found."""
    lead = r"^\s*(\d[\d.,\s\xa0]*+)"
    anywhere = rules.WEIGHT_ANYWHERE + r"(.*)$"
    factor = lambda tons: F.when(tons, 1000.0).otherwise(1.0)

    def first(v):
        # White space, commas and the full stops behind the last digit go at once; the unit is what follows the number.
        digits = F.regexp_replace(F.regexp_extract(v, lead, 1), rf"[,{WS[1:-1]}]+|\.(?=[.,{WS[1:-1]}]*\z)", "")
        return _number(digits, "double") * factor(v.rlike("(?i)" + lead + rules.METRIC_TON[len("(?i)^"):]))

    def second(v):
        return let(drop_spaces(v), lambda x: _number(F.replace(F.regexp_extract(x, anywhere, 1), F.lit(","), F.lit("")), "double")
                   * factor(F.regexp_extract(x, anywhere, 2).rlike(rules.METRIC_TON)))

    return let(c, lambda v: F.coalesce(first(v), second(v)))


# ----------------------------------------------------------------------- dates
def _calendar(parts: Column, y: int, m: int, d: int) -> Column:
    """ISO text of a date from split parts; month as number or English name."""
    table = F.array(*[F.lit(x) for x in rules.MONTHS + rules.MONTH_NAMES])

    def month(word):
        named = let(F.array_position(table, word), lambda p: F.when(p > 0, ((p - 1) % 12 + 1).cast("string")))
        return F.when(word.rlike("^[A-Z]"), named).otherwise(word)

    return let(parts, lambda p: F.when(F.size(p) == 3, F.try_to_date(F.concat_ws(
        "-", F.lpad(F.get(p, y), 4, "0"), F.coalesce(F.lpad(month(F.get(p, m)), 2, "0"), F.lit("x")), F.lpad(F.get(p, d), 2, "0")),
        "yyyy-MM-dd")))


def iso_date(c: Column) -> Column:
    """NRM7: ISO text of a printed date in one of four layouts, else null. All of them have a year of four digits."""
    def raw(v):
        plain = F.when(F.contains(v, F.lit("(")), F.regexp_replace(v, r"\([^)]*\)", " ")).otherwise(v)
        return let(plain, lambda p: F.when(F.contains(p, F.lit(":")), F.regexp_replace(p, r"\b\d{1,2}:\d{2}(:\d{2})?\b", " ")).otherwise(p))

    def found(r):
        numeric = F.regexp_replace(r, r"[^A-Z0-9 ./-]", " ")
        words = squeeze(F.regexp_replace(r, r"[^A-Z0-9 ]", " "))

        def at(text, pattern, cut, y, m, d):
            return let(F.regexp_extract(text, pattern, 0), lambda t: F.when(t != "", _calendar(F.split(t, cut), y, m, d)))

        def in_words(w):
            return F.coalesce(at(w, r"\b\d{1,2}\s+[A-Z]+\s+\d{4}\b", r"\s+", 2, 1, 0),
                              at(w, r"\b[A-Z]+\s+\d{1,2},?\s+\d{4}\b", r",?\s+", 2, 0, 1))

        return let(numeric, lambda n: F.coalesce(
            at(n, r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b", r"[-/.]", 0, 1, 2),
            let(words, in_words),
            at(n, r"\b\d{1,2}[/.]\d{1,2}[/.]\d{4}\b", r"[/.]", 2, 1, 0),
        ))

    return F.date_format(let(F.when(c.rlike(r"\d{4}"), F.upper(bare(c))), lambda v: F.when(v.isNotNull(), let(raw(v), found))), "yyyy-MM-dd")


def naive_utc(c: Column) -> Column:
    """NRM8: ISO timestamp text to a zone-less UTC timestamp, unparseable to null."""
    zone = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"

    def shift(z):
        sign = F.when(F.startswith(z, F.lit("-")), 1).otherwise(-1)
        part = lambda p: F.regexp_extract(z, p, 1).try_cast("int")
        return F.coalesce(sign * (part(r"(\d{2}):?\d{2}") * 60 + part(r"\d{2}:?(\d{2})")), F.lit(0))

    def moved(v):
        local = F.regexp_replace(v, zone, "").try_cast("timestamp_ntz")
        return local + F.make_dt_interval(mins=let(F.regexp_extract(v, zone, 0), shift))

    def read(v):
        # Without a clock time the trailing "-dd" is a day, not a zone.
        return F.when(F.length(v) <= 10, v.try_cast("timestamp_ntz")).otherwise(moved(v))

    return let(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c), read)


def received_time(header: Column, epoch_ms: Column) -> Column:
    """NRM9: the Date header (RFC 2822), else the server's epoch milliseconds."""
    day = r"^(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}:\d{2}(?::\d{2})?) ?([+-]\d{4}|[A-Z]{1,4})?$"
    body = F.regexp_replace(header, r"^[A-Za-z]{3},\s*", "")
    body = squeeze(F.regexp_replace(body, r"\([^)]*\)", ""))
    table = F.array(*[F.lit(m) for m in rules.MONTHS])

    def iso(b):
        g = lambda i: F.regexp_extract(b, day, i)
        month = F.array_position(table, F.upper(g(2))).cast("string")
        clock = F.rpad(g(4), 8, ":00")
        zone = F.when(g(5).rlike(r"^[+-]\d{4}$"), g(5)).otherwise(F.lit("Z"))
        return F.concat(g(3), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(g(1), 2, "0"), F.lit("T"), clock, zone)

    server = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        secs=(epoch_ms / F.lit(1000)).cast("decimal(18,6)"))
    return F.coalesce(naive_utc(let(body, iso)), server)


def edi_date(value: Column, fmt: Column) -> Column:
    """NRM10: an EDI date by its format code; unknown codes keep the text."""
    f = F.trim(fmt)

    def shaped(digits):
        cut = lambda a, n: F.substring(digits, a, n)
        yy = cut(1, 2).try_cast("int")
        century = F.when(yy >= 70, 1900).otherwise(2000)
        return (
            F.when(f.isin("102", "203", "204", "718") & (F.length(digits) >= 8), F.concat_ws("-", cut(1, 4), cut(5, 2), cut(7, 2)))
            .when((f == "101") & (F.length(digits) >= 6), F.concat_ws("-", (century + yy).cast("string"), cut(3, 2), cut(5, 2)))
            .otherwise(strip(value))
        )

    return let(F.regexp_replace(value, r"\D", ""), shaped)


def unit_factor(unit: Column) -> Column:
    """NRM11: kilograms per mass unit, null for anything that is not a mass."""
    table = F.create_map(*[F.lit(x) for kv in rules.UNIT_TO_KG.items() for x in kv])
    return F.try_element_at(table, F.upper(F.trim(unit)))


def place(parts: Column) -> Column:
    """NRM12: ``NAME (CODE)`` from location components in any order."""
    kept = F.filter(F.transform(parts, strip), lambda p: (p != "") & ~p.rlike(r"^-?[\d.,]+$"))
    is_code = lambda p: F.upper(p).rlike("^[A-Z]{5}$")

    def name_and_code(k):
        code = F.upper(F.get(F.filter(k, is_code), 0))
        name = F.get(F.filter(k, lambda p: ~is_code(p)), 0)
        return F.coalesce(F.concat(name, F.lit(" ("), code, F.lit(")")), name, code, F.lit(""))

    return let(kept, name_and_code)


# ------------------------------------------------------------ addresses, labels
def mail_address(c: Column) -> Column:
    """NRM14: bare lower-case address, display name removed."""
    inner = blank_to_null(F.regexp_extract(c, r"<([^>]+)>", 1))
    return F.lower(strip(F.coalesce(inner, c)))


def mail_domain(c: Column) -> Column:
    return let(mail_address(c), lambda a: F.when(F.contains(a, F.lit("@")), F.substring_index(a, "@", -1)))


def bare_message_id(c: Column) -> Column:
    """NRM15: one form of a message id for both sides of a join."""
    return blank_to_null(F.regexp_replace(strip(c), r"^<+|>+$", ""))


def label_from_key(c: Column) -> Column:
    """EXT12: a machine key as printed words."""
    spaced = F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    spaced = F.regexp_replace(spaced, r"(?<=[A-Z])(?=[A-Z][a-z])", " ")
    spaced = F.regexp_replace(spaced, r"[_\-.]+", " ")
    spaced = F.regexp_replace(spaced, r"[^\p{L}\p{N}\s()/%&]", " ")
    return squeeze(spaced)


def clean_extracted(c: Column) -> Column:
    """EXT14: NULs removed, blank runs and blank-line runs shortened."""
    v = F.regexp_replace(c, r"\x00", "")
    v = F.regexp_replace(v, r"[ \t]{2,}", "  ")
    return strip(F.regexp_replace(v, r"\n{3,}", "\n\n"))


def clean_subject(c: Column) -> Column:
    """EXT20: reply prefixes and audit suffixes removed; never emptied."""
    base = strip(c)
    bare = strip(F.regexp_replace(strip(F.regexp_replace(base, rules.AUDIT_SUFFIX, "")), rules.REPLY_PREFIX, ""))
    return F.coalesce(blank_to_null(bare), base, F.lit(""))


def original_sender(c: Column) -> Column:
    """EXT19: first address in a forwarded header block."""
    return F.get(F.regexp_extract_all(c, F.lit(rules.ORIGINAL_SENDER), F.lit(1)), 0)


def unreadable(c: Column) -> Column:
    """EXT2: under 85 % printable characters in the whole text."""
    def mostly_odd(sample):
        odd = F.regexp_count(sample, F.lit(r"[\p{C}\p{Z}&&[^ \n\r\t]]"))
        # Plain ASCII text never gets as far as the counting.
        return sample.rlike(r"[^\x20-\x7e\n\r\t]") & (odd > F.length(sample) * 0.15)

    return let(c, mostly_odd)


# ---------------------------------------------------------- document identifiers
def document_reference(c: Column) -> Column:
    """EXT15: the first labelled reference that has a digit and four characters."""
    found = F.regexp_extract_all(c, F.lit(rules.REFERENCE_LABEL), F.lit(1))
    upper = F.transform(found, lambda x: F.upper(F.regexp_replace(strip(x), r"^[.,;:]+|[.,;:]+$", "")))
    return F.get(F.filter(upper, lambda x: x.rlike(r"\d") & (F.length(x) >= 4)
                          & ~x.isin(rules.NOT_A_REFERENCE)), 0)


def container_numbers(c: Column) -> Column:
    """EXT16: ISO container numbers, distinct, in text order."""
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(rules.CONTAINER_NUMBER), F.lit(1)))


_ENDS = r"^[ .,;]+|[ .,;]+$"


def vessel(c: Column) -> Column:
    """EXT17: labelled vessel name."""
    name = F.regexp_extract(c, rules.VESSEL, 1)
    name = F.regexp_replace(F.regexp_replace(name, rules.VESSEL_TAIL, ""), _ENDS, "")
    return F.get(F.filter(F.array(name), lambda n: (F.length(n) >= 3) & ~n.rlike(r"^\d+$")), 0)


def voyage(c: Column) -> Column:
    """EXT17: labelled voyage number; needs a digit."""
    v = F.regexp_replace(F.regexp_extract(c, rules.VOYAGE, 1), _ENDS, "")
    return F.get(F.filter(F.array(v), lambda x: x.rlike(r"\d")), 0)


def ocr_digits(c: Column) -> Column:
    """NRM13: letters a scanner confuses with digits, when digits are present."""
    return F.when(c.rlike(r"\d"), F.translate(c, "OoIl", "0011")).otherwise(c)
