"""Folder and byte scans, written sinks, and streams over several batches against their batch form."""
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cargolens import rules
from cargolens.operators import issues, versions
from cargolens.sources import documents, history, keyed_table, mail
from cargolens.streaming import jobs


def test_mail_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "email_1.json").write_text(json.dumps({"email_id": "a", "sender": "x@y.z", "subject": "s", "body": "b", "attachments": ["one.txt", "two.pdf"]}))
    (tmp_path / "email_2.json").write_text(json.dumps({"from": "q@y.z", "content": "c\nd", "files": "solo.pdf"}, indent=2))
    (tmp_path / "other.json").write_text("{}")
    rows = {r.email_id: r for r in mail.normalise_mail(mail.read_mail_folder(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a", "email_2"} and rows["a"].attachments == ["one.txt", "two.pdf"]
    assert rows["email_2"].sender == "q@y.z" and rows["email_2"].body == "c\nd" and rows["email_2"].attachments == ["solo.pdf"]


def test_attachment_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"\x00\x01" * 10)
    (tmp_path / "b.bin").write_bytes(b"x" * 5000)
    assert {len(r.content) for r in mail.read_attachments(spark, str(tmp_path)).collect()} == {20, 5000}
    rows = {r.length: r for r in mail.read_attachments(spark, str(tmp_path), 1000).collect()}
    assert rows[20].refused is None and bytes(rows[20].content) == b"\x00\x01" * 10
    assert rows[5000].content is None and rows[5000].refused == "larger than the limit"


def test_submission_is_written_as_json(spark, tmp_path):
    sample = spark.createDataFrame([("a",), ("b",)], "email_id string")
    reports = spark.createDataFrame([("a", "BL_COMPARISON", "ERROR", None, None, ["shipper"])], "email_id string, category string, status string, review_reason string, has_defect boolean, defect_fields array<string>")
    mail.submission(sample, reports).write.json(f"{tmp_path}/out")
    got = {r.email_id: r for r in spark.read.json(f"{tmp_path}/out").collect()}
    assert got["a"].status == "NEEDS_REVIEW" and got["a"].defect_fields == ["shipper"] and got["b"].category == "GENERAL" and got["b"].status == "OK" and got["b"].has_defect is False


def test_corrected_draft_is_written_as_text(spark, tmp_path):
    fields = ["shipper", "consignee", "notify_party", "port_of_loading", "port_of_discharge", "container_count", "gross_weight_kg"]
    bl = spark.createDataFrame([("S1", "in/my bl.txt", 7, 2, *map(str, range(7)))], "shipment_key string, filename string, version_id long, version_number int, " + ", ".join(f"{f} string" for f in fields))
    ok = spark.createDataFrame([("S1", 1, "consignee", "OLD"), ("S1", 2, "consignee", "NEW")], "shipment_key string, reg_id long, field_name string, suggested_value string")
    draft = issues.corrected_draft(bl, ok)
    draft.select("draft").coalesce(1).write.option("lineSep", "\n").text(f"{tmp_path}/draft")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/draft").collect())
    assert "consignee: NEW" in text and "shipper: 0" in text and draft.first().draft_name == "my_bl_Corrected_v2.txt"


def test_json_to_any_depth(spark):
    deep = {"k": "v"}
    for i in range(15):
        deep = {f"n{i}": deep} if i % 2 else {f"n{i}": [deep, {"x": i}]}
    rows = [(1, json.dumps(deep)), (2, json.dumps({"a": list(range(40)), "b": "one\ntwo", "c": [], "d": {}, "e": None, "f": True})), (3, "[]"), (4, '"plain"')]
    df = spark.createDataFrame(rows, "doc int, text string").select("doc", F.parse_json("text").alias("v"))
    got = [(r.doc, r.label, r.value) for r in documents.flatten_json(df).collect()]
    assert sum(1 for d, _, v in got if d == 1 and v == "v") == 1
    assert (2, "a", ", ".join(map(str, range(40)))) in got and (2, "b", "one") in got and (2, "b", "two") in got
    assert not [g for g in got if g[0] in (3, 4)]


def walked(node, path=()):
    """The same rows by recursion over the parsed document."""
    if isinstance(node, dict):
        for k, v in node.items():
            yield from walked(v, path if k.strip().lower() in rules.JSON_IGNORED_SEGMENTS else (*path, k))
    elif isinstance(node, list) and any(isinstance(x, (dict, list)) for x in node):
        for x in node:
            yield from walked(x, path)
    else:
        shown = [x if isinstance(x, str) else f"{x:,}" for x in (node if isinstance(node, list) else [node]) if not isinstance(x, bool) and x is not None]
        for line in ", ".join(x.strip(" ") for x in shown if x.strip(" ")).split("\n"):
            if line.strip() and path:
                yield " ".join(path), line.strip()


def test_json_equals_a_recursive_walk(spark):
    rng = random.Random(6)
    texts = ["a", 'q"uote', "back\\slash", "br[a]ck{e}t", "two\nlines", "", "comma, colon: x", "ü\u0001€", "true", "12"]

    def node(depth):
        kind = rng.random()
        if depth and kind < 0.35:
            return {rng.choice(["data", "alpha", "beta", "gamma", "items", "delta"]): node(depth - 1) for _ in range(rng.randrange(4))}
        if depth and kind < 0.6:
            return [node(depth - 1) for _ in range(rng.randrange(4))]
        return rng.choice([*texts, 1234, -5, 2.5, True, None, [1, "x", None], ["a", 'b"'], []])

    deep = "end"
    for i in range(200):
        deep = {"n": deep} if i % 3 else [deep, {"m": i}]
    docs = [deep, {"long": list(range(30_000)), "text": 'x"\n' * 20_000}, {"rows": [{"leaf": i} for i in range(3_000)]}, *[{"top": node(6)} for _ in range(120)]]
    df = spark.createDataFrame(list(enumerate(map(json.dumps, docs))), "doc int, text string").select("doc", F.parse_json("text").alias("v"))
    flat = documents.flatten_json(df)
    got = sorted((r.doc, r.label, r.value) for r in flat.collect())
    assert got == sorted((i, label, value) for i, d in enumerate(docs) for label, value in walked(d))
    assert "Join" not in flat._jdf.queryExecution().optimizedPlan().toString()


def test_xml_mixed_text(spark):
    xml = "<?xml version='1.0'?><a>x<b>y &lt; z</b> tail <!-- <c>no</c> --><d/><e><![CDATA[<f>1 & 2</f>]]></e></a>"
    assert spark.createDataFrame([(xml,)], "t string").select(documents.xml_lines(F.col("t")).alias("o")).first().o.split("\n") == ["a | x", "b | y < z", "e | <f>1 & 2</f>"]


def streamed(spark, folder, rows, schema, parts):
    """The rows as a stream of several micro-batches, one file each."""
    rng = random.Random(8)
    rows = rows + rng.sample(rows, len(rows) // 5)  # some arrive twice
    rng.shuffle(rows)
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def test_poll_over_batches(spark, tmp_path):
    rows = [(i, f"p{i}") for i in range(60)]
    s = streamed(spark, tmp_path, rows, "event_id long, props string", 4)
    for cp in ("cp1", "cp2"):
        jobs.incremental_poll(s, "event_id", f"{tmp_path}/rows", f"{tmp_path}/{cp}")
    assert sorted(r.event_id for r in jobs.polled(spark, f"{tmp_path}/rows", s.schema).collect()) == list(range(60))


def test_counterparts_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"R{rng.randrange(15)}", rng.choice(["SI", "BL"]), f"m{i}", f"p{i:03d}") for i in range(80)]
    jobs.counterpart_pass(streamed(spark, tmp_path, rows, "ref string, kind string, email_id string, path string", 5), str(tmp_path), f"{tmp_path}/cp")
    got = {r.ref: (r.s, r.b) for r in jobs.counterparts(spark, str(tmp_path)).select("ref", F.col("si_path").alias("s"), F.col("bl_path").alias("b")).collect()}
    first = lambda ref, kind: min((p for r, k, _, p in rows if (r, k) == (ref, kind)), default=None)
    assert got == {r: (first(r, "SI"), first(r, "BL")) for r in {x[0] for x in rows} if first(r, "SI") and first(r, "BL")}


HISTORY = "k long, v string"


def stored(spark, path):
    return sorted(tuple(r) for r in history.read(spark, path, spark.createDataFrame([], HISTORY).schema).select("k", "v").collect())


def add(spark, path, batch_id, rows, combine=None):
    history.append(history.bucketed(spark.createDataFrame(rows, HISTORY), ["k"]), path, "run", batch_id, combine=combine)


def test_history_stays_in_few_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "FAN", 3)
    monkeypatch.setattr(history, "FILE_ROWS", 4)  # a bucket of more rows is several files
    path, want = str(tmp_path), []
    for b in range(14):
        rows = [(i % 5 or None, f"{b}-{i}") for i in range(11)] if b != 6 else []
        add(spark, path, b, rows)
        add(spark, path, b, rows)  # the batch again
        want += rows
        assert len(history.state(spark, path).segments) <= 2 * 3 + 1  # two for each level below, and one merge that is due
    got = sorted(((r.k, r.v) for r in history.read(spark, path).collect()), key=str)
    assert got == sorted(want, key=str) and history.state(spark, path).done == {"run": 13}
    gone = history.remove_merged(spark, path, keep=1)
    assert gone and sorted(((r.k, r.v) for r in history.read(spark, path).collect()), key=str) == sorted(want, key=str)
    assert history.remove_merged(spark, path, keep=1) == []


def test_history_survives_a_writer_lost_in_a_merge(spark, tmp_path, monkeypatch):
    """The merged segment is written, the manifest is not: readers see every row once, and the next batch merges again."""
    monkeypatch.setattr(history, "FAN", 3)
    path, commit = str(tmp_path), history._commit
    for b in range(2):
        add(spark, path, b, [(b, "x"), (7, f"y{b}")])

    def dies(spark, path, now):
        if any(s.level for s in now.segments):
            raise RuntimeError("lost")
        commit(spark, path, now)

    monkeypatch.setattr(history, "_commit", dies)
    with pytest.raises(RuntimeError):
        add(spark, path, 2, [(2, "x")])
    want = [(0, "x"), (1, "x"), (2, "x"), (7, "y0"), (7, "y1")]
    assert stored(spark, path) == want
    monkeypatch.setattr(history, "_commit", commit)
    add(spark, path, 2, [(2, "x")])  # the batch again: its rows were committed, the merge was not
    assert stored(spark, path) == want and [s.level for s in history.state(spark, path).segments] == [1]


def test_history_combines_rows_of_a_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "FAN", 2)
    least = lambda rows: rows.groupBy("k", "bucket").agg(F.min("v").alias("v")).select("k", "v", "bucket")
    for b in range(4):
        add(spark, str(tmp_path), b, [(1, f"v{9 - b}"), (2, "same")], least)
    history.merge(spark, str(tmp_path), spark.createDataFrame([], HISTORY).schema, least)
    assert stored(spark, str(tmp_path)) == [(1, "v6"), (2, "same")]


def test_late_revision_writes_the_tail_only(spark, tmp_path):
    schema = "reg_id long, shipment_key string, doc_type string, content_hash string, normalized_hash string, received_at timestamp_ntz, created_at timestamp_ntz"
    at = lambda h: datetime(2026, 1, 1) + timedelta(hours=h)
    row = lambda i, h: (i, "S", "BL", f"c{i}", f"n{i}", at(h), at(h))
    batches = [[row(i, 10 * i) for i in range(40)], [row(100, 355)], [row(100, 355)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    jobs.revision_chain(s, str(tmp_path), f"{tmp_path}/cp")
    written = {r.batch_id: r.n for r in history.read(spark, f"{tmp_path}/chain").groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert written == {0: 40, 1: 5}  # the late one and four behind it; the repeat changes nothing
    numbers = {r.reg_id: r.version_number for r in jobs.current_chain(spark, str(tmp_path)).collect()}
    assert numbers[100] == 37 and numbers[35] == 36 and numbers[36] == 38 and len(numbers) == 41


def keyed(spark, folder, batches, wait="2 days", delay="0 seconds"):
    """Each list of (ref, kind, path, at) is a micro-batch, in order."""
    schema = "ref string, kind string, path string, at timestamp"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    jobs.run_keyed(jobs.counterpart_state(s, wait, delay), f"{folder}/rows", f"{folder}/cp")
    return spark.read.parquet(f"{folder}/rows")


def test_keyed_counterparts_wait_pair_and_expire(spark, tmp_path):
    at = lambda h: datetime(2026, 1, 1) + timedelta(hours=h)
    out = keyed(spark, tmp_path, [
        [("A", "SI", "a1", at(0)), ("B", "SI", "b1", at(0)), ("C", "BL", "c1", at(0)), ("D", "SI", "d2", at(0)), (None, "SI", "x", at(0)), ("E", "OTHER", "x", at(0)), ("E", "SI", None, at(0))],
        [("A", "BL", "a2", at(10)), ("A", "SI", "a1", at(0)), ("D", "BL", "d5", at(10))],  # a repeat of the first half
        [("D", "SI", "d1", at(20))],  # an earlier path after the pair was made
        [("Z", "SI", "z1", at(500))],  # the watermark passes B's and C's time
        [("Z", "BL", "z2", at(501))],
        [("C", "SI", "c9", at(502))]])  # after C's first half expired
    got = sorted(tuple(r) for r in out.collect())
    assert ("A", "a1", "a2", "PAIRED") in got and sum(g[0] == "A" for g in got) == 1
    assert ("B", "b1", None, "EXPIRED") in got and ("C", None, "c1", "EXPIRED") in got and not [g for g in got if g[0] == "E"]
    pairs = {r.ref: (r.si_path, r.bl_path) for r in jobs.all_counterparts(out).collect()}
    assert pairs == {"A": ("a1", "a2"), "D": ("d1", "d5"), "Z": ("z1", "z2")}


def test_keyed_counterparts_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"R{rng.randrange(12)}", rng.choice(["SI", "BL"]), f"p{i:03d}", datetime(2026, 1, 1) + timedelta(hours=rng.randrange(900))) for i in range(90)]
    parts = [rows[i::4] + rng.sample(rows, 9) for i in range(4)]
    out = keyed(spark, tmp_path, parts, wait="90 days", delay="60 days")
    first = lambda ref, kind: min((p for r, k, p, _ in rows if (r, k) == (ref, kind)), default=None)
    assert {r.ref: (r.si_path, r.bl_path) for r in jobs.all_counterparts(out).collect()} == {
        r: (first(r, "SI"), first(r, "BL")) for r in {x[0] for x in rows} if first(r, "SI") and first(r, "BL")}


def test_revisions_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2026, 1, 1)
    rows = []
    for i in range(90):
        at = None if i % 13 == 0 else start + timedelta(hours=rng.randrange(400))  # late and undated ones among them
        body = f"c{rng.randrange(40)}"
        rows.append((i, f"S{rng.randrange(6)}", rng.choice(["SI", "BL"]), body, "n" + body, at, at))
    schema = "reg_id long, shipment_key string, doc_type string, content_hash string, normalized_hash string, received_at timestamp_ntz, created_at timestamp_ntz"
    jobs.revision_chain(streamed(spark, tmp_path, rows, schema, 4), str(tmp_path), f"{tmp_path}/cp")
    columns = ["reg_id", "version_number", "is_latest", "document_status", "duplicate_of", "previous_version_id"]
    read = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert read(jobs.current_chain(spark, str(tmp_path))) == read(versions.document_versions(spark.createDataFrame(rows, schema)))


def test_unmatched_dispatches_come_out_once(spark, tmp_path):
    at = datetime(2026, 1, 1)
    d = [(1, 10, at), (2, 20, at), (3, 30, at + timedelta(days=30))]
    e = [(10, 100, at + timedelta(hours=5)), (10, 101, at + timedelta(days=9)), (30, 300, at + timedelta(days=40))]
    spark.createDataFrame(d, "dispatch_id long, message_id long, created_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(e, "message_id long, notice_id long, received_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/e")
    ds = spark.readStream.schema("dispatch_id long, message_id long, created_at timestamp").parquet(f"{tmp_path}/d")
    es = spark.readStream.schema("message_id long, notice_id long, received_at timestamp").parquet(f"{tmp_path}/e")
    j = jobs.delivery_join(ds, es, "INTERVAL 2 DAYS", "1 hour").select("dispatch_id", "notice_id")
    jobs.run_to_end(j.writeStream.format("parquet").option("path", f"{tmp_path}/rows"), f"{tmp_path}/cp")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    assert (1, 100) in got and (2, None) in got and sum(1 for x in got if x[0] == 2) == 1


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path, schema = f"{tmp_path}/table", "k long, v string, n long"
    rng, want = random.Random(5), {}
    for batch in range(4):
        rows = [(rng.choice([None, *range(30)]), rng.choice("abc"), rng.randrange(50)) for _ in range(25 if batch else 200)]
        for k, v, n in rows:
            want[k] = max(want.get(k, (-1, "")), (n, v))
        df = spark.createDataFrame(rows, schema)
        touched = keyed_table.upsert_into(df, path, "k", ["n"], f"b{batch}")
        assert touched == sorted({r.bucket for r in df.select(keyed_table._bucket("k").alias("bucket")).collect()})
        assert keyed_table.upsert_into(df, path, "k", ["n"], f"b{batch}") == []  # the batch again
        assert {r.k: (r.n, r.v) for r in keyed_table.read_table(spark, path, schema).collect()} == want
    assert keyed_table.read_table(spark, f"{tmp_path}/none", schema).count() == 0
    assert keyed_table.upsert_into(spark.createDataFrame([], schema), path, "k", ["n"], "empty") == []


def test_upsert_survives_a_lost_writer(spark, tmp_path):
    """Rows written and a manifest begun, but not committed: readers see the table as it was, and the batch can run again."""
    import os
    path, schema = f"{tmp_path}/table", "k long, v string, n long"
    keyed_table.upsert_into(spark.createDataFrame([(1, "a", 1), (2, "a", 1)], schema), path, "k", ["n"], "one")
    second = spark.createDataFrame([(1, "b", 2)], schema)
    keyed_table.upsert_into(second, path, "k", ["n"], "two")
    os.remove(f"{path}/manifest/0000000001-two/_SUCCESS")
    read = lambda: sorted(tuple(r) for r in keyed_table.read_table(spark, path, schema).collect())
    assert read() == [(1, "a", 1), (2, "a", 1)]
    assert keyed_table.upsert_into(second, path, "k", ["n"], "two") and read() == [(1, "b", 2), (2, "a", 1)]


def test_late_rows_complete_the_delivery_stream(spark, tmp_path):
    """Any order of arrival over several batches gives the batch join."""
    rng, start = random.Random(7), datetime(2026, 1, 1)
    d = [(i, rng.randrange(12), start + timedelta(hours=rng.randrange(400))) for i in range(40)]
    e = [(rng.randrange(14), 100 + i, start + timedelta(hours=rng.randrange(400))) for i in range(60)]
    ds_schema, es_schema = "dispatch_id long, message_id long, created_at timestamp", "message_id long, notice_id long, received_at timestamp"
    for name, rows, schema in (("d", d, ds_schema), ("e", e, es_schema)):
        for i in range(5):
            spark.createDataFrame(rows[i::5], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/part={i}")
    read = lambda name, schema, per: spark.readStream.schema(schema).option("maxFilesPerTrigger", per).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")
    j = jobs.delivery_join(read("d", ds_schema, 1), read("e", es_schema, 1), "INTERVAL 2 DAYS", "1 hour").select("dispatch_id", "notice_id")
    jobs.run_to_end(j.writeStream.format("parquet").option("path", f"{tmp_path}/rows"), f"{tmp_path}/cp")
    jobs.late_rows(read("d", ds_schema, 1), "created_at", "1 hour", f"{tmp_path}/ld", f"{tmp_path}/cpd")
    jobs.late_rows(read("e", es_schema, 2), "received_at", "1 hour", f"{tmp_path}/le", f"{tmp_path}/cpe")  # cut otherwise than the joining stream
    all_d, all_e, streamed = spark.createDataFrame(d, ds_schema), spark.createDataFrame(e, es_schema), spark.read.parquet(f"{tmp_path}/rows")
    done = jobs.completed_deliveries(streamed, jobs.read_late(spark, f"{tmp_path}/ld", ds_schema), jobs.read_late(spark, f"{tmp_path}/le", es_schema), all_d, all_e, "INTERVAL 2 DAYS")
    want = set()
    for i, m, at in d:
        met = [n for mm, n, t in e if mm == m and at <= t <= at + timedelta(days=2)]
        want |= {(i, n) for n in met} or {(i, None)}
    got = [tuple(r) for r in done.collect()]
    assert set(got) == want and len(got) == len(want)
    assert {tuple(r) for r in streamed.collect()} != want  # the stream alone had lost some
