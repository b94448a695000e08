from __future__ import annotations

import math

import numpy as np
import pytest
from conftest_llm import SF_MORE, read
from pyspark.sql import functions as F

from fhirlake.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, k=5):
    rows = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and fine(v)})
    out = []
    for i, v in rows:
        if i % 50 == 0:
            others = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i)
            out += [(i, n + 1, j, -score) for n, (score, j) in enumerate(others[:k])]
    return sorted(out)


def mine(df, k=5):
    return sorted(tuple(r) for r in topk.top_k(df, df.filter(F.col("vec_id") % 50 == 0), k).collect())


def drawn(n, width, seed=3):
    values = np.random.default_rng(seed).normal(size=(n, width))
    return [(i, [float(x) for x in v]) for i, v in enumerate(values)]


def test_given_vectors(spark):
    rows = read(SF_MORE, "embeddings", "vec_id, embedding")
    assert mine(spark.read.parquet(f"{SF_MORE}/embeddings.parquet")) == brute(rows)


@pytest.mark.parametrize("block", [64, 128, 2048])
def test_blocks_ties_and_a_hot_vector(table, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rows = drawn(600, 8) + [(1000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, -1.0, 0.0, 0.5]) for i in range(300)]
    rows += [(2000 + i, [float(i % 3), 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(120)]
    df = table([(i, v, 1, "b") for i, v in rows], f"{SCHEMA}, rank int, block string").repartition(5)
    assert mine(df) == brute(rows)


def test_odd_vectors(table):
    rows = drawn(40, 3) + [(50, None), (100, [math.nan] * 3), (150, [None, 1.0]), (200, [math.inf]), (250, []), (300, [5.0])]
    rows += [(None, [1.0] * 3), (350, [1e9] * 3), (400, [1.0] * 9), (400, [2.0]), (350, [1e9] * 3), (451, [-0.3] * 3)]
    assert mine(table(rows, SCHEMA)) == brute(rows)
    assert mine(table(rows, SCHEMA), 100) == brute(rows, 100)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(0, []), (1, []), (50, [])], [(1, [1.0]), (2, [2.0])]])
def test_few_rows(table, rows):
    assert mine(table(rows, SCHEMA)) == brute(rows)


@pytest.mark.parametrize("known", [False, True])
def test_reading_stops_before_the_lists_end(known):
    """Bounds hold at every depth, and with a good start most entries are passed over."""
    rng = np.random.default_rng(5)
    vectors = np.floor(256 * rng.normal(size=(2048, 16)) / 4)
    weights = np.floor(256 * rng.normal(size=(100, 16)) / 4)
    order = np.argsort(-vectors.T, 1, kind="stable")
    lists = topk.Lists(order, np.take_along_axis(vectors.T, order, 1))
    scores = weights @ vectors.T
    kth = np.sort(scores, 1)[:, -6]
    query, place, found = topk.search(lists, weights, kth if known else np.full(100, -np.inf), 6)
    assert np.array_equal(found, scores[query, place])
    for q in range(100):
        best = set(np.flatnonzero(scores[q] >= kth[q]))
        assert best <= set(place[query == q])
    assert lists.at < 2048
    assert len(query) <= topk.FEW * scores.size
