"""The maintained overview against the full form after several batches, and a batch that dies and is repeated."""
import random

import pytest

from cargolens.operators import overview as O
from cargolens.sources import keyed_table
from cargolens.streaming import overview as M

VERSION = "reg_id long, shipment_key string, doc_type string, email_id string, document_status string, version_number int, is_latest boolean"
ISSUE = "issue_key string, shipment_key string, field_name string, status string"
REPORT = "report_id long, email_id string, category string, status string, review_reason string, has_defect boolean"


def shown(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_batches_equal_the_full_form(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    ships = [(f"S{i}",) for i in range(12)] + [(None,)]
    held = {"v": {}, "i": {}, "r": {}}

    def some(kind, n):
        rows = []
        for _ in range(n):
            if kind == "v":
                k = rng.randrange(40)
                row = (k, f"S{k % 14}", ["SI", "BL", "INVOICE"][k % 3], f"m{k % 9}" if k % 5 else None, rng.choice(["ACTIVE", "DUPLICATE"]), rng.randrange(4), rng.random() < 0.5)
            elif kind == "i":
                k = rng.randrange(20)
                row = (f"k{k}", f"S{k % 14}", f"f{k % 4}", rng.choice(["SUGGESTED", "SUPERSEDED", "APPROVED"]))
            else:
                k = rng.randrange(15)
                row = (k, f"m{k % 11}", rng.choice(["BL_COMPARISON", "GENERAL"]), rng.choice(["OK", "NEEDS_REVIEW"]), rng.choice([None, "why"]), None)
            rows.append(row)
        rows = list({r[0]: r for r in rows}.values())  # one state per key and batch
        held[kind].update({r[0]: r for r in rows})
        return rows

    upsert = keyed_table.upsert_into

    def dies(*a):
        raise RuntimeError("lost")

    for b in range(3):
        batch = dict(shipments=spark.createDataFrame(ships if b == 1 else ships[:6], "shipment_key string"), versions=spark.createDataFrame(some("v", 18), VERSION),
                     issues=spark.createDataFrame(some("i", 9), ISSUE) if b else None, reports=spark.createDataFrame(some("r", 7), REPORT))
        if b == 1:  # lost after the histories were written and before the table was
            monkeypatch.setattr(keyed_table, "upsert_into", dies)
            with pytest.raises(RuntimeError):
                M.maintain(spark, str(tmp_path), b, **batch)
            monkeypatch.setattr(keyed_table, "upsert_into", upsert)
        M.maintain(spark, str(tmp_path), b, **batch)
    full = O.overview(spark.createDataFrame(ships[:-1], "shipment_key string"), spark.createDataFrame(list(held["v"].values()), VERSION),
                      spark.createDataFrame(list(held["i"].values()), ISSUE), spark.createDataFrame(list(held["r"].values()), REPORT))
    got = M.current(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(full.columns)
    assert shown(got) == shown(full) and got.count() == 12
    # A report alone touches the shipments of its mail only; a finished batch again changes nothing.
    M.maintain(spark, str(tmp_path), 3, reports=spark.createDataFrame([(99, "m1", "BL_COMPARISON", "NEEDS_REVIEW", "late", None)], REPORT))
    changed = {r.shipment_key for r in keyed_table.read_table(spark, f"{tmp_path}/table", M.OVERVIEW).where("batch_id = 3").collect()}
    assert changed == {v[1] for v in held["v"].values() if v[3] == "m1"} & {s for s, in ships}
    after = shown(M.current(spark, str(tmp_path)))
    M.maintain(spark, str(tmp_path), 3, reports=spark.createDataFrame([(99, "m1", "GENERAL", "OK", None, None)], REPORT))
    assert shown(M.current(spark, str(tmp_path))) == after


def test_nothing_yet_is_empty(spark, tmp_path):
    M.maintain(spark, str(tmp_path), 0)
    M.maintain(spark, str(tmp_path), 1, shipments=spark.createDataFrame([], "shipment_key string"))
    assert M.current(spark, str(tmp_path)).count() == 0
