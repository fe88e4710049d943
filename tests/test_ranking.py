"""Numbering against brute force, with one key holding most rows."""
from pyspark.sql import functions as F

from cargolens.operators.ranking import latest, numbered


def test_hot_key_numbering(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", (i * 37) % 101, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at int, id int").repartition(6)
    got = {(r.k, r.id): r.rn for r in numbered(df, ["k"], [F.col("at"), F.col("id")], "rn", [F.floor(F.col("at") / 10)]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            want[(key, r[2])] = n
    assert got == want
    last = {r.k: r.id for r in latest(df, ["k"], [F.col("at"), F.col("id")]).collect()}
    assert all(got[(k, i)] == max(v for (kk, _), v in got.items() if kk == k) for k, i in last.items())
