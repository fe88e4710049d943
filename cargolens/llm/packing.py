"""Best-fit packing of token pieces by a configuration linear program over the length histogram."""
from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from .bpe import CACHE, CACHED_CHARS, WORD_END, Vocabulary, vocabulary
from .common import cut

CAPACITY = 4096
END = 1  # id that ends a document
GROUP_CHARS = 8_000_000  # characters encoded at once
SLICE_BITS = 14  # rows numbered together: 2 ** 14 neighbours of one partition
PHASES, ROUNDS = 3, 24  # linear programs solved one after another on what is left, and price updates in each
PARTS = (1.0, 0.3)  # of the volume that a rounded solution is scaled to
STEP = 0.5  # of a length's demand that one round may cover
DECAY = 4.0  # how fast covered lengths lose their price
NEAR = 0.02  # configurations this close to the best price are taken in one round


# ---------------------------------------------------------------- tokens

TOGETHER = 200  # words the library encodes as one text
MARKS = ".,;:!?*()[]\"'"


@lru_cache(maxsize=2)
def library(path: str) -> tuple[Tokenizer, np.ndarray]:
    """The tokenizer file's own library, and which ids end a pre-token."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the workers side by side
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, np.array([s.endswith(WORD_END) for s in vocabulary(path).strings])


def _learn(words: set[str], v: Vocabulary, path: str) -> None:
    """Remembers the ids of new words; the library encodes many as one text, where each ends with a final id."""
    new = [w for w in words if w not in v.known and w.isalpha() and len(w) <= CACHED_CHARS and unicodedata.is_normalized("NFC", w)]
    if len(v.known) + len(new) > CACHE:
        v.known.clear()
    t, final = library(path)
    for start in range(0, len(new), TOGETHER * 50):
        part = new[start:start + TOGETHER * 50]
        ids = [i for e in t.encode_batch_fast([" ".join(part[i:i + TOGETHER]) for i in range(0, len(part), TOGETHER)], add_special_tokens=False) for i in e.ids]
        ends = (np.flatnonzero(final[ids]) + 1).tolist()
        if len(ends) == len(part):  # else a word is cut otherwise than this module expects, and is encoded when met
            v.known.update(zip(part, (tuple(ids[a:b]) for a, b in zip([0, *ends], ends))))


def encoded(texts: list[str], v: Vocabulary, path: str) -> list[np.ndarray]:
    """Token ids of each text. Runs between white space repeat, so each distinct run of a group is encoded once."""
    plain, odd = [], {}
    for i, t in enumerate(texts):
        if v.odd_space.search(t) or any(a in t for a in v.added):
            odd[i] = np.array(v.encode(t), np.uint32)
            t = ""
        elif t.isascii():
            t = v.normalised(t)
        else:
            t = " ".join(v.normalised(t).split())
        plain.append(t)
    lists = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
    runs = lists.flatten().dictionary_encode()
    distinct = runs.dictionary.to_pylist()
    _learn({r.strip(MARKS) for r in distinct}, v, path)
    known = [_run_ids(r, v) for r in distinct]
    widths = np.fromiter(map(len, known), np.int32, len(known))
    starts = (np.cumsum(widths) - widths).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(known), np.uint32, int(widths.sum()))
    codes = runs.indices.to_numpy()
    n = widths[codes]
    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int32)]).astype(np.int32)  # a group has fewer ids than 32 bits count, unless one text alone has more bytes
    ids = flat[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1], dtype=np.int32)]
    bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return [odd[i] if i in odd else ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]


def _run_ids(run: str, v: Vocabulary) -> tuple[int, ...]:
    """Ids of a run. Its pre-tokens are remembered, not the run: words repeat under many punctuations."""
    known = v.known.get(run)
    if known is not None:
        return known
    if run.isalpha():
        return v.remembered(run)
    if run[-1:] in (".", ",") and run[:-1].isalpha():
        return v.remembered(run[:-1]) + v.remembered(run[-1])
    return tuple(i for p in v.pieces.findall(run) for i in v.remembered(p))


def _groups(texts: list[str]):
    """Ranges of neighbouring texts of bounded total length; a longer text is a range of its own."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t) > GROUP_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]``: each document's ids and an end id, cut where they exceed the capacity."""
    raw = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut_up(batches):
        v = vocabulary(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in _groups(texts):
                rows, piece, start, length, crc, parts = [], [], [], [], [], []
                for i, ids in enumerate(encoded(texts[lo:hi], v, path)):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for k, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s:s + capacity]
                        rows.append(lo + i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(crc32(part.tobytes()))
                        if with_ids:
                            parts.append(part.astype(np.int32))
                columns = {"doc_id": b.column("doc_id").take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                           "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array(parts, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return raw.mapInArrow(cut_up, schema)


# ---------------------------------------------------------------- configurations

def priced(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for every room the highest total price of pieces in it, and the longest piece of such a filling.

    ``prices[l]`` is the price of a piece of length l, minus infinity where there is none.
    """
    room = len(prices) - 1
    best, piece = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    by_rest = prices[::-1].copy()
    for w in range(1, room + 1):
        totals = by_rest[room - w:room] + best[:w]  # at i: a piece of length w - i and the best of room i
        i = int(totals.argmax())
        if totals[i] > best[w - 1]:
            best[w], piece[w] = totals[i], w - i
        else:
            best[w] = best[w - 1]  # a token stays empty
    return best, piece


def _filled(seeds: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Configurations made of one seed piece and the best filling of the rest: (configuration, length, how often), sorted."""
    room = len(piece) - 1
    config, length = [np.arange(len(seeds))], [seeds]
    who, rest = np.arange(len(seeds)), room - seeds
    while len(who):
        take = piece[rest]
        rest = np.where(take > 0, rest - take, rest - 1)
        got = take > 0
        config.append(who[got])
        length.append(take[got])
        live = rest > 0
        who, rest = who[live], rest[live]
    key, times = np.unique(np.concatenate(config) * (room + 1) + np.concatenate(length), return_counts=True)
    return key // (room + 1), key % (room + 1), times


def linear_program(demand: np.ndarray, rounds: int = ROUNDS) -> tuple[dict[tuple, float], float]:
    """Fractional configurations that cover the demand per length, and a lower bound of their number.

    Multiplicative weights: a length's price starts at its length and falls by a factor with
    every share of its demand that is covered. In each round the knapsack's dynamic program
    prices all configurations; of every length the best one that holds it is taken, if it
    is near the best of all, as often as lets no length be covered by more than the step.
    Prices over the best price are a dual solution, so each round gives a lower bound.
    """
    lengths, wanted = np.arange(len(demand)), demand > 0
    d, covered = np.maximum(demand, 1).astype(float), np.zeros(len(demand))
    volume, bound, plan = float((demand * lengths).sum()), 0.0, {}
    for _ in range(rounds):
        prices = np.where(wanted, lengths * np.exp(-DECAY * covered / d), -np.inf)
        best, piece = priced(prices)
        bound = max(bound, float((demand[wanted] * prices[wanted]).sum() / best[-1]))
        held = np.flatnonzero(wanted)
        seeds = held[prices[held] + best[len(demand) - 1 - held] >= (1 - NEAR) * best[-1]]
        config, length, times = _filled(seeds, piece)
        often = np.full(len(seeds), np.inf)
        np.minimum.at(often, config, d[length] / times)
        use = np.bincount(length, weights=times * often[config], minlength=len(demand))
        share = np.ones(len(seeds))
        np.minimum.at(share, config, STEP * d[length] / use[length])
        often *= share
        covered += np.bincount(length, weights=times * often[config], minlength=len(demand))
        cuts = np.searchsorted(config, np.arange(len(seeds) + 1))
        for k, x in enumerate(often.tolist()):
            parts = tuple(zip(length[cuts[k]:cuts[k + 1]].tolist(), times[cuts[k]:cuts[k + 1]].tolist()))
            plan[parts] = plan.get(parts, 0.0) + x
        if (np.minimum(covered, demand) * lengths).sum() >= 0.999 * volume:
            break
    return plan, bound


def best_fit(left: np.ndarray) -> list[tuple[tuple, int]]:
    """Packs pieces longest first: a rest is filled by one piece or two that fill it exactly, else by the longest that fits.

    A configuration is repeated while its pieces last, so the steps depend on the number of
    lengths and not of pieces.
    """
    left, out, longest = left.copy(), [], len(left) - 1
    while True:
        while longest > 0 and not left[longest]:
            longest -= 1
        if longest == 0:
            return out
        config, room = {longest: 1}, len(left) - 1 - longest
        left[longest] -= 1
        while room > 0:
            a = np.arange(min(room - 1, longest), (room - 1) // 2, -1)
            pairs = a[(left[a] > 0) & (left[room - a] > (2 * a == room))]
            fits = np.flatnonzero(left[:min(room, longest) + 1])
            if room <= longest and left[room]:
                take = [room]
            elif len(pairs):
                take = [int(pairs[0]), room - int(pairs[0])]
            elif len(fits):
                take = [int(fits[-1])]
            else:
                break
            for x in take:
                config[x] = config.get(x, 0) + 1
                left[x] -= 1
                room -= x
        for x, c in config.items():
            left[x] += c
        times = min(int(left[x]) // c for x, c in config.items())
        for x, c in config.items():
            left[x] -= times * c
        out.append((tuple(sorted(config.items())), times))


def _rounded(left: np.ndarray, plan: dict[tuple, float], part: float) -> list[tuple[tuple, int]]:
    """Whole numbers of full configurations, taken out of ``left``: the plan scaled to a part of the volume and rounded down, at least to 1.

    Configurations with the longest pieces come first; each is used while its pieces are there.
    """
    capacity, out = len(left) - 1, []
    volume = int((left * np.arange(capacity + 1)).sum())
    scale = max(1.0, part * volume / capacity / max(sum(plan.values()), 1e-9))
    for parts, x in sorted(plan.items(), key=lambda p: (-p[0][-1][0], -p[1], p[0])):
        times = min(max(1, int(x * scale)), *(int(left[n]) // c for n, c in parts))
        if times > 0 and sum(n * c for n, c in parts) == capacity:
            out.append((parts, times))
            for n, c in parts:
                left[n] -= times * c
    return out


def configurations(demand: np.ndarray) -> tuple[list[tuple[tuple, int]], int]:
    """Whole configurations ``((length, how often), ...), number`` that hold the demand exactly, and a lower bound of sequences.

    ``demand[l]`` counts the pieces of length l; its last entry those as long as a sequence.
    The linear program's solution is rounded for all of the volume and for a part of it;
    what is left is solved and rounded anew, and after each time best fit completes it. The
    completion with the fewest sequences is the result.
    """
    capacity, best = len(demand) - 1, None
    left = demand.astype(np.int64).copy()
    left[capacity] = 0
    full = [(((capacity, 1),), int(demand[capacity]))] if demand[capacity] else []
    if not left.any():
        return full, int(demand[capacity])
    first, bound = linear_program(left)
    for part in PARTS:
        rest, taken = left.copy(), []
        for phase in range(PHASES):
            if not rest.any():
                break
            taken += _rounded(rest, first if phase == 0 else linear_program(rest)[0], part)
            done = taken + best_fit(rest)
            used = sum(n for _, n in done)
            if best is None or used < best[0]:
                best = used, done
        if best[0] <= bound + 1e-6:
            break
    return full + best[1], int(np.ceil(bound - 1e-6)) + int(demand[capacity])


class Places:
    """Where the r-th piece of a length goes: sequence and offset, by binary search over the configurations."""

    def __init__(self, configs: list[tuple[tuple, int]]):
        rows, base, seen = [], 0, {}
        for parts, number in configs:
            at = 0
            for length, times in parts:
                rows.append((length, seen.get(length, 0), base, times, at))
                seen[length] = seen.get(length, 0) + times * number
                at += length * times
            base += number
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.first = {int(n): i for i, n in reversed(list(enumerate(self.rows[:, 0])))}
        self.count = {int(n): int(c) for n, c in zip(*np.unique(self.rows[:, 0], return_counts=True))}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            table = self.rows[self.first[n]:self.first[n] + self.count[n]]
            row = table[np.searchsorted(table[:, 1], rank[mine], "right") - 1]
            past = rank[mine] - row[:, 1]
            sequence[mine] = row[:, 2] + past // row[:, 3]
            offset[mine] = row[:, 4] + past % row[:, 3] * n
        return sequence, offset


# ---------------------------------------------------------------- pieces to places

def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]`` per piece of a document.

    Every document is its token ids and an end id; one that exceeds the capacity is cut into
    pieces as long as a sequence and a rest. Pieces are placed in as few sequences of at most
    that many tokens as the method finds, one behind the other without a gap.

    1. Pieces are made in Arrow batches and written to the checkpoint folder with a row number.
    2. Their histogram, at most one row per length up to the capacity at any number of
       documents, goes to the driver, where the configuration program is solved.
    3. The pieces of a length are numbered slice by slice; slices are neighbouring rows of one
       written partition, so a length that a third of all pieces share is many slices. A
       number gives a piece its place by binary search in the configurations, whose number
       depends on the capacity and not on the data.

    A null or empty text is one piece with the end id alone. Repeated rows are documents of
    their own. Null ids stay. Other columns are ignored. An empty table gives no rows.
    """
    pieces = cut(token_pieces(docs, path, capacity, end, with_ids, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    pieces = pieces.withColumn("_slice", F.shiftright("_row", SLICE_BITS))
    counts = cut(pieces.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n")))
    demand = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most one row per length
        demand[r["length"]] = r["n"]
    places = Places(configurations(demand)[0])
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_slice")) - F.col("_n"))
    ranked = pieces.join(before.select("length", "_slice", "_before"), ["length", "_slice"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy("length", "_slice").orderBy("_row")) - 1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    more = ["ids"] if with_ids else []
    types = {f.name: f.dataType.simpleString() for f in pieces.schema.fields} | {"sequence_id": "long", "offset": "long"}
    wanted = [*columns, "sequence_id", "offset", *more]

    def placed(batches):
        for b in batches:
            sequence, offset = places(b.column("length").to_numpy(), b.column("_rank").to_numpy())
            b = b.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield b.select(wanted)

    return ranked.select(*columns, *more, F.col("_rank").cast("long").alias("_rank")).mapInArrow(placed, ", ".join(f"{c} {types[c]}" for c in wanted))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, offsets`` of pieces packed with their ids: the training sequences, none longer than the capacity."""
    part = F.struct("offset", "doc_id", "ids")
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    return held.select("sequence_id", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"),
                       F.transform("_parts", lambda p: p["doc_id"]).alias("doc_ids"), F.transform("_parts", lambda p: p["offset"]).alias("offsets"))
