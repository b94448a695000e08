from __future__ import annotations

import numpy as np
import pyarrow as pa
from conftest_llm import SF_MORE

from fhirlake.llm import quality


def test_estimate_finds_the_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.85
    on_good, on_bad = np.array([0.998, 0.995, 0.999, 0.992]), np.array([0.9, 0.6, 0.4, 0.7])
    right = rng.random((20_000, 4)) < np.where(good[:, None], on_good, on_bad)
    votes = np.where(right == good[:, None], quality.GOOD, quality.BAD)
    votes[rng.random(votes.shape) < 0.2] = quality.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    assert abs(model.share - 0.85) < 0.02
    assert np.abs(model.on_good - on_good).max() < 0.01 and np.abs(model.on_bad - on_bad).max() < 0.05
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.97


def test_a_labeller_that_misfires_on_good_texts():
    rng = np.random.default_rng(3)
    good = rng.random(100_000) < 0.85
    on_bad = np.array([0.9, 0.6, 0.5, 0.7, 0.5, 0.6, 0.7, 0.4, 0.4])
    for wrong in (0, 2, 8):
        on_good = np.full(9, 0.997)
        on_good[wrong] = 2 / 3
        right = rng.random((len(good), 9)) < np.where(good[:, None], on_good, on_bad)
        votes = np.where(right == good[:, None], quality.GOOD, quality.BAD)
        votes[rng.random(votes.shape) < 0.2] = quality.ABSTAIN
        patterns, counts = np.unique(votes, axis=0, return_counts=True)
        model = quality.estimate(patterns, counts.astype(float))
        kept = model.posterior(votes) > 0.5
        misjudged = good & (votes[:, wrong] == quality.BAD)
        assert abs(model.on_good[wrong] - 2 / 3) < 0.02
        assert kept[misjudged].mean() > 0.97 and kept[good & ~misjudged].mean() > 0.99 and kept[~good].mean() < 0.06


def test_against_the_labels(spark):
    docs = spark.read.parquet(f"{SF_MORE}/documents.parquet")
    found = quality.score(docs, quality.train(docs)).join(spark.read.parquet(f"{SF_MORE}/labels.parquet"), "doc_id")
    rows = [(r["quality"], r["keep"]) for r in found.collect()]
    good, bad = [k for q, k in rows if q == 1], [k for q, k in rows if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.25


def test_edges(table):
    clean = "The house by the river was old and the people who lived in it were kind to all. " * 3
    rows = [(1, clean), (1, clean), (None, clean), (2, None), (3, ""), (4, " \n"), (5, "word " * 200_000), (6, "é")]
    df = table([(i, t, 0.5, "k") for i, t in rows], "doc_id long, text string, score double, keep string")
    model = quality.train(df)
    found = sorted((str(r["doc_id"]), r["keep"], r["score"]) for r in quality.score(df, model).collect())
    assert len(found) == len(rows) and all(0 <= s <= 1 for *_, s in found)
    assert [k for i, k, _ in found if i in "234"] == [False] * 3
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert kept.filter("doc_id = 1 or doc_id is null").count() == 3 and kept.filter("doc_id in (2, 3, 4)").count() == 0


def test_empty_table(table):
    none = table([], "doc_id long, text string")
    assert quality.score(none, quality.train(none)).count() == 0
    assert quality.keep_good(none).count() == 0


def test_features_are_made_of_small_runs():
    batch = pa.RecordBatch.from_arrays([pa.nulls(4000), pa.array(["some words of a text " * 20] * 4000)], names=["none", "text"])
    runs = [run for _, run in quality.texts([batch])]
    assert sum(run.n for run in runs) == 4000 and max(len(run.raw) for run in runs) <= 1 << 17
