"""Secret scans: fixed patterns and sliding-window entropy, as spans in code points."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let

# The base patterns.
ASSIGN_HEAD = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+"
# Runs of these two are maximal, so asking for their length in the pattern gives the same spans as dropping short ones after.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6  # characters of an assigned value


@dataclass(frozen=True)
class CharClass:
    """Candidate runs of one alphabet, the window, and the bits a window needs."""

    name: str
    alphabet: str
    window: int
    bits: float


CLASSES = (
    CharClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 20, 3.6),
    CharClass("entropy_hex", "0123456789ABCDEFabcdef", 20, 3.0),
)

#: A candidate that matches one of these is not reported: identifiers, placeholders, paths, names, dates.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(?:[-_][0-9a-fA-F]{4}){3}[-_][0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|xxxxx|12345678",
    r"^[A-Za-z]*+(?:[/_-][A-Za-z]++)++[/_-]?[0-9]{0,4}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"^[A-Za-z]+[0-9]{0,4}$",
)

CHUNK = 128


def _running(lengths: Column) -> Column:
    """Sums of all earlier elements: chunks are summed apart, then the sums of the chunks before each are added."""
    def running(part: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, zero, lambda s, x: F.struct((s["n"] + x).alias("n"), F.concat(s["out"], F.array(s["n"])).alias("out")))

    n_chunks = F.ceil(F.size(lengths) / CHUNK).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n_chunks - 1, F.lit(0))), lambda i: running(F.slice(lengths, i * CHUNK + 1, CHUNK)))
    return let(parts, lambda ps: F.flatten(F.zip_with(
        ps, running(F.transform(ps, lambda p: p["n"]))["out"], lambda p, before: F.transform(p["out"], lambda x: x + before))))


def _matches(text: Column, pattern: str) -> Column:
    """All leftmost matches: array of (start, end, hit). What lies between them comes from a split by the same pattern."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})"), 1)
    gaps = F.split(text, pattern, -1)

    def located(h: Column) -> Column:
        lengths = F.zip_with(gaps, h, lambda g, x: (F.char_length(g) + F.coalesce(F.char_length(x), F.lit(0))).cast("long"))
        return let(_running(lengths), lambda before: let(gaps, lambda g: F.transform(h, lambda x, i: F.struct(
            (F.get(before, i) + F.char_length(F.get(g, i))).alias("start"),
            (F.get(before, i) + F.char_length(F.get(g, i)) + F.char_length(x)).alias("end"), x.alias("hit")))))

    return let(hits, located)


NONE = "array<struct<start:bigint,end:bigint,hit:string>>"


def _found(text: Column, probe: Column, pattern: str, keep) -> Column:
    """Matches of a pattern that pass ``keep``; texts that fail the cheap probe skip the work."""
    return F.when(probe, F.filter(_matches(text, pattern), keep)).otherwise(F.array().cast(NONE))


def _entropy(run: Column, c: CharClass) -> Column:
    """Highest entropy of any window of the run.

    Counts per character and the sum of c*log2(c) are carried along: the incoming character
    adds its step, the outgoing one takes its own away.
    """
    step = F.array(*[F.lit(0.0 if n == 0 else (n + 1) * math.log2(n + 1) - n * math.log2(n)) for n in range(c.window + 1)])
    chars = F.split(run, "")
    place = lambda ch: F.instr(F.lit(c.alphabet), ch) - 1
    start = F.struct(F.array_repeat(F.lit(0), len(c.alphabet)).alias("n"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))

    def slide(codes: Column) -> Column:
        def go(s: Column, i: Column) -> Column:
            new, old = F.get(codes, i), F.when(i >= c.window, F.get(codes, i - c.window))

            def after_out(removed: Column) -> Column:
                counts, total = removed["n"], removed["sum"]
                grown = total + F.get(step, F.get(counts, new))
                best = F.when(i >= c.window - 1, F.greatest(s["best"], F.lit(math.log2(c.window)) - grown / c.window)).otherwise(s["best"])
                return F.struct(F.transform(counts, lambda x, k: F.when(k == new, x + 1).otherwise(x)).alias("n"), grown.alias("sum"), best.alias("best"))

            less = F.when(old.isNotNull(), F.struct(
                F.transform(s["n"], lambda x, k: F.when(k == old, x - 1).otherwise(x)).alias("n"),
                (s["sum"] - F.get(step, F.get(s["n"], old) - 1)).alias("sum"))).otherwise(F.struct(s["n"].alias("n"), s["sum"].alias("sum")))
            return let(less, after_out)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, go)["best"]

    return let(F.transform(chars, place), slide)


def _allowed(run: Column) -> Column:
    ok = F.lit(False)
    for p in ALLOWED:
        ok = ok | run.rlike(p)
    return ok


def _of_class(text: Column, c: CharClass) -> Column:
    alphabet = "[" + c.alphabet.replace("-", r"\-") + "]"
    pattern = f"{alphabet}{{{c.window},}}"

    def secret(m: Column) -> Column:
        run = m["hit"]
        mixed = run.rlike("[0-9]") & run.rlike("[A-Za-z]")
        return mixed & ~_allowed(run) & (_entropy(run, c) >= c.bits)

    return _found(text, text.rlike(pattern), pattern, secret)


def spans(text: Column, classes: tuple[CharClass, ...] = CLASSES) -> dict[str, Column]:
    """Arrays of (start, end, hit) per kind, base kinds first."""
    value = lambda m: F.char_length(F.regexp_replace(m["hit"], "^" + ASSIGN_HEAD, ""))
    base = {
        "assign": _found(text, text.rlike(ASSIGN), ASSIGN, lambda m: value(m) >= LEAST_VALUE),
        "access": _found(text, text.rlike(ACCESS), ACCESS, lambda m: F.lit(True)),
        "hex": _found(text, text.rlike(HEX), HEX, lambda m: F.lit(True)),
    }
    return base | {c.name: _of_class(text, c) for c in classes}


def _joined(tagged: Column) -> Column:
    return F.array_join(F.transform(tagged, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _tagged(kinds: list[str]) -> Column:
    """The spans of several kinds by start, then kind in the order given."""
    def tagged(at: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("at"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    return F.array_sort(F.flatten(F.array(*[tagged(i, k) for i, k in enumerate(kinds)])))


def _latest(events: Column) -> Column:
    """For each event what came before it: the furthest end of a span and the last run. Chunks are folded apart, then what came before each joins."""
    def joined(x: Column, y: Column) -> Column:
        return F.struct(F.greatest(x["reach"], y["reach"]).alias("reach"), F.greatest(x["run"], y["run"]).alias("run"))

    def folded(part: Column) -> Column:
        nothing = F.expr(f"CAST(named_struct('reach', -1, 'run', named_struct('start', -1, 'end', -1)) AS {SEEN})")
        zero = F.struct(nothing.alias("all"), F.array().cast(f"array<{SEEN}>").alias("out"))
        return F.aggregate(part, zero, lambda s, x: F.struct(joined(s["all"], x).alias("all"), F.concat(s["out"], F.array(s["all"])).alias("out")))

    n_chunks = F.ceil(F.size(events) / CHUNK).cast("int")
    seen = F.transform(events, lambda e: F.struct(e["reach"].alias("reach"), e["run"].alias("run")))
    parts = let(seen, lambda es: F.transform(F.sequence(F.lit(0), F.greatest(n_chunks - 1, F.lit(0))), lambda i: folded(F.slice(es, i * CHUNK + 1, CHUNK))))
    return let(parts, lambda ps: F.flatten(F.zip_with(
        ps, folded(F.transform(ps, lambda p: p["all"]))["out"], lambda p, before: F.transform(p["out"], lambda x: joined(x, before)))))


SEEN = "struct<reach:bigint,run:struct<start:bigint,end:bigint>>"


def _outside(runs: Column, kinds: list[str]) -> Column:
    """The parts of runs that lie in no span of the given kinds; a run apart from all of them is one part.

    Runs, their ends and the spans are events in order of place. Before an event lie the
    last run and the furthest end of a span; what is between the two and the event is a part.
    """
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    event = lambda at, order, reach, run: F.struct(at.alias("at"), F.lit(order).alias("order"), reach.alias("reach"), run.alias("run"))
    before, no_run = F.lit(-1).cast("long"), lambda: pair(F.lit(-1).cast("long"), F.lit(-1).cast("long"))
    opened = F.transform(runs, lambda r: event(r["start"], 1, before, pair(r["start"], r["end"])))
    closed = F.transform(runs, lambda r: event(r["end"], 0, r["end"], no_run()))
    spans = [F.transform(F.col(k), lambda b: event(b["start"], 2, b["end"], no_run())) for k in kinds]
    events = F.array_sort(F.concat(opened, closed, *spans))

    def parts(es: Column) -> Column:
        cut = F.zip_with(es, _latest(es), lambda e, s: pair(F.greatest(s["reach"], s["run"]["start"]), F.least(e["at"], s["run"]["end"])))
        return F.filter(cut, lambda p: (p["start"] >= 0) & (p["start"] < p["end"]))

    return F.when(F.size(runs) > 0, let(events, parts)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def secret_scan(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the text, ``found``, the sorted spans (start, at, kind, end) of each document, and ``cover``.

    Base kinds are leftmost non-overlapping matches, short ones dropped after matching.
    Entropy kinds add candidate runs that hold letters and digits, match no allow-list
    pattern and contain a window of enough bits; of a run that overlaps spans reported
    before it, ``found`` has the parts outside them and ``cover`` the whole run. Positions
    are code points, ends exclusive. A null text is empty and has no spans. Every input row
    gives one row; other columns are ignored. The work is linear in a text's length.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    kinds = list(BASE)
    out = raw
    for name, column in spans(F.col("text"), classes).items():
        out = out.withColumn(name, column)
    out = out.withColumn("cover", _tagged(list(BASE) + [c.name for c in classes]))
    for c in classes:
        out = out.withColumn(c.name, _outside(F.col(c.name), kinds))
        kinds.append(c.name)
    return out.select("doc_id", "text", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
                      _tagged(list(BASE)).alias("base"), _tagged(kinds).alias("found"), "cover")


def digest(scan: DataFrame) -> DataFrame:
    """The counts and span lists of a scan, without texts."""
    return scan.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


MARK = "[SECRET]"


def redacted(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES) -> DataFrame:
    """All documents with all their columns; every span found is replaced by a mark.

    A run of high entropy goes as a whole where only a part of it is a base span.
    Overlapping spans give one mark. ``n_chars``, where the table has it, follows the text.
    A null text stays null.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc_id"), F.col("text"))
    scanned = secret_scan(packed, classes).select(F.col("doc_id").alias("_row"), "text", "cover")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    done = F.aggregate("cover", zero, lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(x["start"] >= s["at"], F.concat(s["out"], piece(s["at"], x["start"]), F.lit(MARK))).otherwise(s["out"]).alias("out")))
    clean = let(done, lambda s: F.concat(s["out"], piece(s["at"], F.char_length("text"))))
    out = scanned.withColumn("_text", F.when(F.col("_row.text").isNull(), F.lit(None).cast("string")).when(F.size("cover") > 0, clean).otherwise(F.col("text")))
    fresh = {"text": F.col("_text"), "n_chars": F.when(F.size("cover") > 0, F.char_length("_text").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in columns else None}
    return out.select(*[(fresh[c] if c in fresh else F.col(f"_row.`{c}`")).alias(c) for c in columns])
