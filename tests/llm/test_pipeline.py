from __future__ import annotations

import pytest
from conftest_llm import SF, SF_MORE
from test_decontamination import brute as holds
from test_near_duplicates import brute as classes

import __spark_entry__ as contract
import corpus_pipeline
from fhirlake.llm import queries
from tools import compare


def test_stages_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF_MORE}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_MORE}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_MORE}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_MORE)
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {i for i, _ in rows}
            break
        assert out.columns == docs.columns
        kept = [(r["doc_id"], r["text"]) for r in out.collect()]
        ids, was = {i for i, _ in kept}, {i for i, _ in rows}
        if name == "quality":
            assert all(i in ids for i in was if labels.get(i) == 1)
            assert sum(i in ids for i in was if labels.get(i) == 0) < 0.25 * sum(labels.get(i) == 0 for i in was)
        elif name == "near-duplicates":
            assert ids == {c for _, c in classes(rows)} and len(kept) == len(ids)
        elif name == "decontamination":
            assert ids == was - {i for i, _ in holds(rows, items)}
        elif name == "secrets":
            assert ids == was
            changed = {i for i, t in kept if t != dict(rows)[i]}
            assert changed == {i for i, t in rows if any(w.startswith('"') and len(w.strip('"#!$%&*')) == 40 for w in t.split())}
        rows = kept
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_run_gives_the_last_stage_s_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_registered_once_per_operator():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert contract.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_statement(spark, name):
    assert compare.differences(spark, compare.connect(SF), SF, name) is None
