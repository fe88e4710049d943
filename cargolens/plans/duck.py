"""SQL snippets for the oracles (DuckDB dialect). Used by checks only."""
from __future__ import annotations

from .. import rules

WS = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(e, pattern, to="", flags="g"):
    return f"regexp_replace({e}, {q(pattern)}, {q(to)}, {q(flags)})"


def ext(e, pattern, group=1):
    return f"regexp_extract({e}, {q(pattern)}, {group})"


def has(e, pattern):
    return f"regexp_matches({e}, {q(pattern)})"


def strip(e):
    return sub(e, f"^{WS}+|{WS}+$")


def squeeze(e):
    return f"trim({sub(e, WS + '+', ' ')})"


def nospace(e):
    return sub(e, WS + "+")


def up(e):
    """Full upper-casing: DuckDB keeps a capital sharp s where Unicode writes SS."""
    return f"replace(upper({e}), chr(7838), 'SS')"


def cut_address(e):
    return strip(sub(e, rules.ADDRESS_CUT))


def value_or_null(e):
    return f"CASE WHEN NOT {has(squeeze(e), rules.PLACEHOLDER)} THEN nullif({e}, '') END"


def clean_name(e):
    v = sub(strip(e), rules.TRAILING_LABELS)
    v = sub(v, r"(?s)[ \t\x{a0}]{3,}.*")
    return up(squeeze(cut_address(sub(v, WS + "+", " "))))


def clean_port(e):
    return up(squeeze(sub(strip(e), rules.TRAILING_LABELS)))


def norm_name(e):
    base = squeeze(sub(up(cut_address(e)), r"[^A-Z0-9 ]+", " "))
    bare = squeeze(sub(base, rules.LEGAL_SUFFIXES, " "))
    return f"CASE WHEN length({bare}) >= 4 THEN {bare} ELSE {base} END"


def port_code(e):
    return f"nullif({ext(f'upper({e})', r'\(([A-Z]{5})\)')}, '')"


def port_name(e):
    return norm_name(sub(strip(f"upper({e})"), r"\([A-Z]{5}\)", " "))


def norm_port(e):
    return f"CASE WHEN {e} IS NOT NULL THEN trim(concat_ws(' ', {port_name(e)}, {port_code(e)})) END"


def container_count(e):
    compact = f"replace({nospace(e)}, ',', '')"
    parts = f"list_filter(list_transform(string_split_regex({e}, {q(rules.CONTAINER_JOIN)}), lambda p: {strip('p')}), lambda p: p <> '')"
    specs = f"list_transform({parts}, lambda p: {ext(nospace('p'), rules.CONTAINER_SPEC)})"
    return (f"CASE WHEN {has(f'upper({compact})', '^[A-Z]{4}[0-9]{7}$')} THEN NULL "
            f"WHEN len({specs}) >= 2 AND NOT list_contains({specs}, '') THEN list_sum(list_transform({specs}, lambda s: try_cast(s AS BIGINT))) "
            f"ELSE try_cast({ext(compact, '([0-9]+)')} AS BIGINT) END")


def weight_kg(e):
    lead = r"(?s)^\s*([\d][\d.,\s\x{a0}]*)(.*)$"
    anyw = rules.WEIGHT_ANYWHERE + "(.*)$"
    def scaled(n, rest):
        return f"CASE WHEN {has(rest, rules.METRIC_TON)} THEN {n} * 1000.0::DOUBLE ELSE {n} END"
    first = f"try_cast(replace({sub(nospace(ext(e, lead, 1)), '[.,]+$')}, ',', '') AS DOUBLE)"
    second = f"try_cast(replace({ext(nospace(e), anyw, 1)}, ',', '') AS DOUBLE)"
    return f"coalesce({scaled(first, ext(e, lead, 2))}, {scaled(second, ext(nospace(e), anyw, 2))})"


def iso_date(e):
    raw = sub(sub(f"upper({strip(e)})", r"\([^)]*\)", " "), r"\b\d{1,2}:\d{2}(:\d{2})?\b", " ")
    num = sub(raw, "[^A-Z0-9 ./-]", " ")
    words = squeeze(sub(raw, "[^A-Z0-9 ]", " "))
    names = "[" + ",".join(q(m) for m in rules.MONTHS + rules.MONTH_NAMES) + "]"

    def month(x):
        return f"nullif((list_position({names}, {x}) - 1) % 12 + 1, 0)"

    def day(y, m, d):
        return (f"try_cast(lpad({y}, 4, '0') || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)")
    ymd = r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b"
    dmw = r"\b(\d{1,2})\s+([A-Z]+)\s+(\d{4})\b"
    mdw = r"\b([A-Z]+)\s+(\d{1,2}),?\s+(\d{4})\b"
    dmy = r"\b(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b"
    return ("strftime(coalesce(" + ", ".join([
        day(ext(num, ymd, 1), ext(num, ymd, 2), ext(num, ymd, 3)),
        day(ext(words, dmw, 3), month(ext(words, dmw, 2)), ext(words, dmw, 1)),
        day(ext(words, mdw, 3), month(ext(words, mdw, 1)), ext(words, mdw, 2)),
        day(ext(num, dmy, 3), ext(num, dmy, 2), ext(num, dmy, 1)),
    ]) + "), '%Y-%m-%d')")


def any_of(e, words):
    return "(" + " OR ".join(f"contains({e}, {q(w)})" for w in words) + ")"


def hits(subject, body, words):
    return "(" + " + ".join(f"CAST(contains({subject}, {q(w)}) OR contains({body}, {q(w)}) AS INT)" for w in words) + ")"


def in_list(e, words):
    return f"{e} IN (" + ",".join(q(w) for w in words) + ")"


def sqlist(words):
    return "[" + ",".join(q(w) for w in words) + "]"


def si_bl(e):
    stem, suffix = f"lower({ext(e, r'(?s)^(.+)[.][^.]*$')})", f"lower({ext(e, r'(?s)^.+[.]([^.]*)$')})"

    def claim(tokens, phrases):
        return (f"(list_has_any(string_split_regex({stem}, '[^a-z0-9]+'), {sqlist(tokens)}) OR "
                + any_of(sub(stem, "[^a-z0-9]"), phrases) + ")")
    si, bl = claim(rules.SI_TOKENS, rules.SI_PHRASES), claim(rules.BL_TOKENS, rules.BL_PHRASES)
    return (f"CASE WHEN {in_list(suffix, rules.DOC_SUFFIXES)} THEN CASE WHEN {si} AND NOT {bl} THEN 'SI' WHEN {bl} AND NOT {si} THEN 'BL' END END")


def atts(e="attachments_csv"):
    return f"list_filter(string_split({e}, '|'), lambda a: a <> '')"
