"""Quality rules: a threshold table compiled into one projection of ratios."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from .common import WORD_BREAK, words

WINDOW = 8  # words in a window whose repetition counts

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "are", "as", "with", "be", "by", "this", "from", "or", "an", "at",
    "der", "die", "und", "das", "ist", "den", "von", "zu", "mit", "dem", "für", "sie", "nicht", "auf", "es", "ein", "eine", "als", "im",
    "de", "la", "le", "les", "des", "est", "et", "du", "dans", "pour", "qui", "au", "que", "en", "un", "une", "par",
    "el", "y", "los", "se", "las", "una", "por", "con", "del", "su", "al", "lo",
]


@dataclass(frozen=True)
class Rule:
    """A document passes when ``low <= metric <= high``; a missing bound is open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are per word or per line of the text.
RULES = (
    Rule("mean_word_chars", low=2.0, high=20.0),
    Rule("symbol_ratio", high=0.25),
    Rule("stop_ratio", low=0.01),
    Rule("dup_line_ratio", high=0.5),
    Rule("repeat_ratio", high=0.3),
)


def _window_hashes(w: Column) -> Column:
    """One 64-bit hash per window of eight words, by doubling: 1, 2, 4, then 8 words."""
    def doubled(h: Column, step: int) -> Column:
        pairs = F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        return F.slice(pairs, 1, F.greatest(F.size(h) - step, F.lit(0)))

    one = F.transform(w, lambda x: F.xxhash64(x))
    return let(one, lambda a: let(doubled(a, 1), lambda b: let(doubled(b, 2), lambda c: doubled(c, 4))))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, each word once.

    Windows are sorted by (hash, position); neighbours with the same hash are repeats.
    Their positions, sorted, cover the gap to the next one, at most a window's length.
    """
    def starts(s: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            return (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])

        return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(repeated(x, i), F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    gaps = let(ordered, lambda s: let(starts(s), lambda p: F.aggregate(
        F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0), lambda n, g: n + g)))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), gaps).otherwise(0)


def metrics(text: Column) -> Column:
    """Counts and ratios of a text as one struct.

    A null text counts as empty: every count is 0 and every ratio 0. Lines are separated
    by ``\\n``; only lines that hold a word count. Two windows are equal when their 64-bit
    hashes are. Everything is bound by ``let``, so a filter that Catalyst pushes down or
    merges evaluates each part once.
    """
    def parts(t: Column) -> Column:
        return F.struct(words(t).alias("w"), F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\f\r")) != "").alias("l"),
                        (F.size(F.split(t, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"))

    def counts(p: Column) -> Column:
        w, l = p["w"], p["l"]
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), p["n_symbols"].alias("n_symbols"),
            (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"), let(_window_hashes(w), _covered).cast("long").alias("n_repeat_words"),
            F.size(l).cast("long").alias("n_lines"), F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"))

    def ratios(c: Column) -> Column:
        per = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(0.0)
        return F.struct(*[c[n].alias(n) for n in COUNTS], per("word_chars", "n_words").alias("mean_word_chars"), per("n_symbols", "n_words").alias("symbol_ratio"),
                        per("n_stop", "n_words").alias("stop_ratio"), per("n_dup_lines", "n_lines").alias("dup_line_ratio"), per("n_repeat_words", "n_words").alias("repeat_ratio"))

    return let(F.coalesce(text, F.lit("")), lambda t: let(parts(t), lambda p: let(counts(p), ratios)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop")


def base_failed(m: Column) -> Column:
    """Fewer than 20 words, or over 30 % of the words in repeated windows."""
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def passes(m: Column, rules: tuple[Rule, ...]) -> Column:
    """The threshold table compiled into one Boolean column over a metrics struct."""
    ok = ~base_failed(m)
    for r in rules:
        if r.low is not None:
            ok = ok & (m[r.metric] >= r.low)
        if r.high is not None:
            ok = ok & (m[r.metric] <= r.high)
    return ok


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict per document: the metrics, ``base_failed`` and ``kept``.

    Base: fewer than 20 words, or over 30 % of the words in repeated windows. ``kept``
    needs the base to pass and every rule of the table. Null, empty and blank texts fail
    the base. Each input row gets one output row, repeated rows included; an empty table
    gives no rows. Columns other than the id and the text are ignored.
    """
    m = F.col("_m")
    measured = docs.select(F.col(id_col).alias("doc_id"), metrics(F.col(text_col)).alias("_m"))
    return measured.select("doc_id", "_m.*", base_failed(m).alias("base_failed"), passes(m, rules).alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with all their columns, each row judged by its own text."""
    return docs.where(let(metrics(F.col("text")), lambda m: passes(m, rules)))
