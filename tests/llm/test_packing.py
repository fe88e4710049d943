"""Packing: ids against the library, places against their rules, numbers of sequences against bounds."""
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cargolens.llm import packing
from helpers import awkward, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, packed, capacity):
    """Pieces cover every document in order, and every sequence without gap or overlap."""
    want = sorted(((i, k, s, len(ids[s:s + capacity]), zlib.crc32(np.array(ids[s:s + capacity], "<u4").tobytes()))
                   for i, t, *_ in rows for ids in [library_ids(t)] for k, s in enumerate(range(0, len(ids), capacity))), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=str) == want
    held = defaultdict(list)
    for r in packed:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


ODD = ["Ａ Straße ÉCOLE naïve école H̱a", "it's, don't. 12 3.5 a,b... (c) !? <|startoftext|> x<|endoftext|>y", "tab\tand\x1funit em nbsp", "İstanbul ΣΑΣ ﬁ", "a" * 500, "x.y" * 60]


def test_ids_and_places(spark):
    rows = awkward() + [(50 + i, t, "a") for i, t in enumerate(ODD)] + [(70, ODD[0], "a")] * 3
    packed = packing.pack(documents(spark, rows), PATH).collect()
    assert check(rows, packed, 4096) <= sum(len(library_ids(t)) for _, t, _ in rows) // 4096 + 2


def test_small_sequences_and_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BITS", 2)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("river stone light tree".split()) for _ in range(rng.randint(0, 90))), "s") for i in range(300)]
    rows += [(1000 + i, "same text in very many documents", "s") for i in range(200)]
    docs = documents(spark, rows, clash=False).withColumnRenamed("source", "_row").withColumnRenamed("lang", "_slice")
    packed = packing.pack(docs, PATH, capacity=64, with_ids=True)
    got = packed.collect()
    n = check(rows, got, 64)
    total = sum(len(library_ids(t)) for _, t, _ in rows)
    assert n <= -(-total // 64) + 2
    ids = {(r.doc_id, r.piece): r.ids for r in got}
    for s in packing.sequences(packed).collect():
        mine = sorted((r.offset, r.doc_id, r.piece) for r in got if r.sequence_id == s.sequence_id)
        assert s.ids == [x for _, d, p in mine for x in ids[d, p]] and s.doc_ids == [d for _, d, _ in mine] and s.offsets == [o for o, _, _ in mine]


def test_empty_tables(spark):
    assert packing.pack(documents(spark, []), PATH).count() == 0
    only = packing.pack(documents(spark, [(None, None, None), (1, "", "a")]), PATH).collect()
    assert check([(None, None), (1, "")], only, 4096) == 1


def test_knapsack_prices_every_room():
    rng = np.random.default_rng(0)
    prices = np.full(41, -np.inf)
    for n in (3, 7, 11, 16, 40):
        prices[n] = rng.uniform(1, 5)
    best, piece = packing.priced(prices)
    brute = [0.0] * 41
    for w in range(1, 41):
        brute[w] = max([brute[w - 1]] + [prices[n] + brute[w - n] for n in (3, 7, 11, 16, 40) if n <= w])
    assert np.allclose(best, brute) and all(piece[w] == 0 or np.isfinite(prices[piece[w]]) for w in range(41))


def lower_bounds(demand):
    capacity = len(demand) - 1
    big = int(demand[capacity // 2 + 1:].sum())
    return max(big, -(-int((demand * np.arange(capacity + 1)).sum()) // capacity))


@pytest.mark.parametrize("name, lengths, slack", [
    ("mixed", lambda r: r.integers(1, 100, 5000), 0.01), ("no small ones", lambda r: r.integers(26, 40, 3000), 0.02), ("one length", lambda r: np.full(900, 34), 0),
    ("halves", lambda r: np.full(901, 50), 0), ("few", lambda r: np.array([60, 50, 50, 40, 99, 1]), 0), ("hot", lambda r: np.r_[np.full(10**6, 33), np.full(10**6, 1), r.integers(1, 101, 10**4)], 0)])
def test_number_of_sequences(name, lengths, slack):
    demand = np.bincount(lengths(np.random.default_rng(1)), minlength=101)
    configs, bound = packing.configurations(demand)
    used = sum(n for _, n in configs)
    held = np.zeros(101, np.int64)
    for parts, n in configs:
        assert sum(x * c for x, c in parts) <= 100
        for x, c in parts:
            held[x] += c * n
    assert (held == demand).all()
    least = lower_bounds(demand) if name != "one length" else 450
    least = least if name != "no small ones" else -(-int(demand.sum()) // 3)  # three of them at most fit
    assert bound <= used and used <= least * (1 + slack) + 1


def test_work_does_not_grow_with_the_pieces():
    demand = np.bincount(np.random.default_rng(2).integers(1, 256, 4000), minlength=257)
    many = packing.configurations(demand * 10 ** 6)[0]
    assert len(many) <= 256 * 4 and sum(n for _, n in many) <= 1.01 * lower_bounds(demand * 10 ** 6)
    places = packing.Places(many)
    n = int(np.flatnonzero(demand)[0])
    sequence, offset = places(np.full(1000, n), np.arange(1000))
    assert len(set(zip(sequence.tolist(), offset.tolist()))) == 1000
