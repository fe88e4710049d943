"""The n-gram join against all pairs, also with tiny tiles and large groups."""
import random
from collections import Counter, defaultdict

from cargolens.llm import jaccard
from helpers import awkward, documents


def brute(rows, threshold=0.8, aligned=False):
    def grams(t):
        w = [x for x in (t or "").encode().split()]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [grams(t) for _, t, *_ in rows]
    root, links = list(range(len(rows))), Counter()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g] if j > i).items():
            if n / len(s | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[top(i)] = min(low.get(top(i), r[0]), r[0])
    if aligned:
        return [top(i) for i in range(len(rows))]
    return sorted(((r[0], low.get(top(i)), links[i]) for i, r in enumerate(rows)), key=str)


def crowd(copies, words=60, changes=4, seed=1):
    """A text, exact copies of it and near copies at many distances."""
    rng = random.Random(seed)
    base = [f"{chr(97 + rng.randrange(26))}{rng.randrange(900)}" for _ in range(words)]
    out = []
    for i in range(copies):
        w = list(base)
        at = rng.randrange(words - changes)
        for k in range(rng.randint(0, changes)):
            w[(at + k * rng.choice([1, 1, 3])) % words] = f"n{rng.randrange(9999)}"
        out.append((1000 * seed + i, " ".join(w), "s"))
    return out


def joined(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(df).collect()), key=str)


def test_band_choice():
    b, r = jaccard.bands_and_rows()
    assert b * r <= jaccard.MAX_HASHES and 1 - (1 - 0.8 ** r) ** b >= jaccard.RECALL
    assert jaccard.bands_and_rows(0.5, 0.9, 20)[1] >= 1


def test_join_equals_all_pairs(spark):
    rows = awkward() + crowd(60, seed=1) + crowd(40, words=12, changes=1, seed=2) + crowd(30, words=300, changes=20, seed=3) + [(9000 + i, "same words in every one of these", "s") for i in range(50)]
    assert joined(documents(spark, rows)) == brute(rows)


def test_join_with_tiny_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_TEXTS", 7)
    rows = crowd(80, seed=4) + crowd(30, words=40, changes=3, seed=5)
    assert joined(documents(spark, rows)) == brute(rows)


def test_one_of_each(spark):
    rows = awkward() + crowd(40, seed=6) + [(6003, "another text under a known id with enough words", "s"), (6003, "another text under a known id with enough words", "s")]
    docs = documents(spark, rows)
    out = jaccard.one_of_each(docs)
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == docs.columns and all(n == 1 for (_, t), n in kept.items() if t and t.strip())
    worded = [r for r in rows if r[1] and r[1].strip()]
    of_class = defaultdict(set)
    for r, c in zip(worded, brute(worded, aligned=True)):
        of_class[c] |= {(r[0], r[1])} & set(kept)
    assert all(len(rs) == 1 for rs in of_class.values())
    assert sum(1 for r in rows if not (r[1] or "").strip()) == sum(n for (_, t), n in kept.items() if not (t or "").strip())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"x", b"y")], "key binary, other binary")
    roots = {bytes(r.key): bytes(r.root) for r in jaccard.components(edges).collect()}
    assert set(roots.values()) == {bytes([0]), b"x"} and len(roots) == 43


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert jaccard.jaccard_join(docs).count() == jaccard.one_of_each(docs).count() == 0
    only_blank = documents(spark, [(1, None, "a"), (2, " ", "a")])
    assert joined(only_blank) == [(1, 1, 0), (2, 2, 0)] and jaccard.one_of_each(only_blank).count() == 2
