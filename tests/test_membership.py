"""Membership filters against the keys they were built from, and the poll that skips its ledger by them."""
import pytest
from pyspark.sql import functions as F

from cargolens.operators import incremental
from cargolens.sources import history, membership
from cargolens.streaming import jobs

KEYS = "k string"


def marked(spark, keys):
    return history.bucketed(spark.createDataFrame([(k,) for k in keys], KEYS), ["k"])


def test_sizes_are_powers_of_two():
    assert [membership.blocks_for(n) for n in (0, 1, 3276, 3277, 6553, 6554, 100_000)] == [1, 1, 1, 2, 2, 4, 32]


def test_no_stored_key_is_denied_and_few_others_pass(spark):
    stored = spark.range(60_000).select(F.concat(F.lit("k"), "id").alias("k")).withColumn("bucket", F.lit(0))
    filters = membership.build(stored, "k", {0: 60_000})
    filters.persist()
    assert {r.blocks for r in filters.select("blocks").distinct().collect()} == {32} and filters.count() == 32
    assert membership.may_hold(stored, "k", filters).count() == 60_000
    others = spark.range(20_000).select(F.concat(F.lit("new"), "id").alias("k")).withColumn("bucket", F.lit(0))
    assert membership.may_hold(others, "k", filters).count() < 400  # two in a hundred; it takes about half a hundredth here
    filters.unpersist()


def test_filters_of_several_sizes_and_a_null_key(spark):
    small, large = marked(spark, [None, "a", "", "a"]), marked(spark, [f"k{i}" for i in range(500)])
    large = large.withColumn("bucket", F.lit(3))
    filters = membership.build(small, "k", history.sizes(small)).unionByName(membership.build(large, "k", {3: 50_000}))
    asked = marked(spark, [None, "a", "", "b"]).unionByName(large)
    got = {r.k for r in membership.may_hold(asked, "k", filters).collect()}
    assert {None, "a", "", *(f"k{i}" for i in range(500))} <= got


def test_history_keeps_filters_through_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "FAN", 2)
    path = str(tmp_path)
    for b in range(5):
        history.append(marked(spark, [f"{b}-{i}" for i in range(20)]), path, "run", b, key="k")
    asked = marked(spark, [f"{b}-{i}" for b in range(5) for i in range(20)] + [f"x{i}" for i in range(100)])
    got = {r.k for r in history.may_hold(asked, path, "k").collect()}
    assert {f"{b}-{i}" for b in range(5) for i in range(20)} <= got and len(got) < 110
    history.remove_merged(spark, path, keep=1)
    assert {r.k for r in history.may_hold(asked, path, "k").collect()} == got
    history.append(marked(spark, ["plain"]), path, "run", 5)  # a segment without a filter: nothing may be denied
    assert history.may_hold(asked, path, "k").count() == 200


def test_no_history_holds_nothing(spark, tmp_path):
    assert history.may_hold(marked(spark, ["a"]), f"{tmp_path}/none", "k").count() == 0


@pytest.mark.parametrize("small", [0, 200_000])
def test_poll_skips_the_ledger_for_new_keys(spark, tmp_path, monkeypatch, small):
    """Both ways to meet the ledger: by broadcast below the bound, by shuffle above it."""
    monkeypatch.setattr(jobs, "SMALL", small)
    schema = "k string, v long"
    batches = [[(f"a{i}", i) for i in range(300)] + [(None, 1)], [(f"b{i}", i) for i in range(300)], [("a7", 0), (None, 0), ("c", 0), ("c", 1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    jobs.incremental_poll(s, "k", f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r.k: r.v for r in jobs.polled(spark, f"{tmp_path}/out", s.schema).collect()}
    assert got == {**{f"a{i}": i for i in range(300)}, **{f"b{i}": i for i in range(300)}, None: 1, "c": 0}
    figures = {r.batch_id: (r["keys"], r.asked) for r in jobs.poll_figures(spark, f"{tmp_path}/out").collect()}
    assert figures[0] == (301, 0) and figures[1][1] < 30 and figures[2] == (3, 2)


def test_unseen_by_filter_is_exact(spark, tmp_path):
    incoming = spark.createDataFrame([(i, f"m{i % 50}" if i % 10 else None) for i in range(200)], "n int, message_key string")
    seen = spark.createDataFrame([("m3",), ("m3",), ("m44",), (None,), ("other",)], "message_key string")
    got = {r.n for r in incremental.unseen_by_filter(incoming, seen, f"{tmp_path}/a").collect()}
    assert got == {i for i in range(200) if i % 10 and i % 50 not in (3, 44)}
    assert incremental.unseen_by_filter(incoming, seen.limit(0), f"{tmp_path}/b").count() == 200
