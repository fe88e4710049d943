"""Registered queries against their oracles, and the pipeline against brute force, on the smallest tables."""
import hashlib
import os
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cargolens.llm import catalog, queries
from check import ROOT, compare, duck
from test_jaccard import brute
from cargolens.llm.secrets import digest, secret_scan
from helpers import awkward, documents
from test_native import SECRET_TEXTS, base_counts, base_spans, brute_mix

SF = f"{ROOT}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_oracle(spark, name):
    assert compare(spark, duck(SF), name, catalog.queries()[name], catalog.oracle_sql()[name], SF)[2] == "ok"


def test_secret_sql_on_awkward_texts(spark):
    """The same SQL over texts full of secrets, near-secrets and allowed strings."""
    rows = awkward() + [(100 + i, t, "s") for i, t in enumerate(SECRET_TEXTS)]
    con = duck(SF)
    con.execute("CREATE TABLE odd (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO odd VALUES (?, ?)", [r[:2] for r in rows])
    fn = lambda s, d: digest(secret_scan(documents(s, rows)))
    assert compare(spark, con, "op6", fn, queries.span_sql("odd"), SF)[2] == "ok"


def test_all_operators_are_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_join_over_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in catalog.queries()["op4_jaccard_join"](spark, SF).collect()), key=str)
    assert got == brute(rows)


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before, after = docs.collect(), out.collect()
        seen.append(name)
        if name != "bpe_encoding":
            assert out.columns == columns
        if name == "quality_rules":
            failed = {r.doc_id for r in before if base_counts(r.text)[-1]}
            assert not failed & {r.doc_id for r in after} and {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
        elif name == "jaccard_join":
            classes = brute([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == {c for _, c, _ in classes} and len(after) == len({c for _, c, _ in classes})
        elif name == "secret_scan":
            assert len(after) == len(before) and not any(base_spans(r.text) for r in after)
            secretive = {r.doc_id for r in before if base_spans(r.text)}
            assert {(r.doc_id, r.text) for r in before if r.doc_id not in secretive} <= {(r.doc_id, r.text) for r in after}
        elif name == "source_mix":
            plan = {i: taken for i, _, _, _, taken in brute_mix([(r.doc_id, r.text, r.source) for r in before])}
            words = {}
            for r in after:
                words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
            assert words == {i: n for i, n in plan.items() if n}
        else:
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            t.no_truncation()
            t.no_padding()
            want = []
            for r in before:
                ids = t.encode(r.text, add_special_tokens=False).ids
                want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))
            assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in after) == sorted(want)
        docs = out
    assert len(seen) == 5 and corpus_pipeline.run(spark, SF).count() == docs.count()
