from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import SF, read

from fhirlake.llm.neighbours import Files, nearest


def brute(rows, asked, k):
    """rank -> (vec_id, score) per query"""
    fine = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    fine = list({(i, tuple(v)): (i, v) for i, v in fine}.values())
    out = {}
    for q, vector in fine:
        if asked(q):
            found = sorted((-float(x @ vector), i) for i, x in fine if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def mine(df, queries, k, **settings):
    out = defaultdict(list)
    for r in sorted(nearest(df, queries, k, **settings).collect()):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(a, b):
    return a.keys() == b.keys() and all(
        [i for i, _ in a[q]] == [i for i, _ in b[q]] and np.allclose([s for _, s in a[q]], [s for _, s in b[q]], rtol=1e-12) for q in a
    )


def recall(got, x, queries):
    hits = {}
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        assert len(got[q]) == 20 and np.allclose([s for _, s in got[q]], [score[i] for i, _ in got[q]], rtol=1e-12)
        hits[q] = len(set(np.argsort(-score)[:20]) & {i for i, _ in got[q]}) / 20
    return hits


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = dict(read(SF, "embeddings", "vec_id, embedding"))
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], np.float64)
    assert ids == list(range(len(ids)))
    found = recall(mine(df, df.filter("vec_id % 20 = 0"), 20), x, range(0, len(ids), 20))
    assert np.mean(list(found.values())) >= 0.9


def test_recall_with_the_query_s_own_settings(spark):
    """50,000 rows in four blocks; a third of them in one cluster."""
    rng = np.random.default_rng(2)
    x, hot = rng.normal(size=(50_000, 64)).astype(np.float32).astype(np.float64), np.arange(50_000) % 3 == 1
    x[hot] = rng.normal(size=64) + 0.1 * x[hot]
    x /= np.linalg.norm(x, axis=1)[:, None]
    values = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 64).cast(pa.list_(pa.float64()))
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(50_000)), "embedding": values}))
    found = recall(mine(df, df.filter("vec_id % 500 = 0"), 20), x, range(0, 50_000, 500))
    inside = np.mean([r for q, r in found.items() if hot[q]])
    outside = np.mean([r for q, r in found.items() if not hot[q]])
    print("recall", inside, outside)
    assert inside >= 0.9 and outside >= 0.9


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12_000, 48)) * rng.uniform(0.5, 2, (12_000, 1))  # lengths differ, nothing is clustered
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = mine(df, df.filter("vec_id % 100 = 0"), 20, block_rows=6_000)
    assert np.mean(list(recall(got, x, range(0, 12_000, 100)).values())) >= 0.9


def test_files_give_the_footrule_order():
    rng = np.random.default_rng(3)
    near = np.array([rng.permutation(30)[:8] for _ in range(400)], np.int16)
    files, m = Files(near, 30), 8
    for own in near[:20]:
        distance = [sum(abs((list(own).index(p) if p in own else m) - (list(v).index(p) if p in v else m)) for p in {*own, *v}) for v in near]
        wanted = np.lexsort((np.arange(400), distance))[:50]
        assert set(files.ranked(own, 50)) == set(wanted)


@pytest.mark.parametrize("spread", [0.003, 0.1])
def test_recall_with_a_third_in_one_cluster(spark, spread):
    rng = np.random.default_rng(1)
    x, hot = rng.normal(size=(12_000, 64)), np.arange(12_000) % 3 == 1
    x[hot] = rng.normal(size=64) + spread * x[hot]
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = mine(df, df.filter("vec_id % 100 = 0"), 20, block_rows=6_000)
    hits = defaultdict(list)
    for q in range(0, 12_000, 100):
        score = x @ x[q]
        score[q] = -np.inf
        hits[bool(hot[q])].append(len(set(np.argsort(-score)[:20]) & {i for i, _ in got[q]}) / 20)
    print("recall", {h: np.mean(r) for h, r in hits.items()})
    assert np.mean(hits[False]) >= 0.9 and np.mean(hits[True]) >= 0.9


def test_edges(table):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0])]
    rows += [(None, [1.0, 1.0]), (7, [3.0, 1.0]), (140, []), (160, [-1.0, -1.0])] + [(200 + i, [0.5, 0.5]) for i in range(50)]
    df = table([(i, v, i, 0) for i, v in rows], "vec_id long, embedding array<double>, id long, block int")
    want = brute(rows, lambda q: q % 20 == 0, 20)
    assert same(mine(df, df.filter("vec_id % 20 = 0"), 20), want)
    assert same(mine(df, df.filter("vec_id % 20 = 0"), 200, block_rows=9, rerank_each=1, rerank_share=1.0), brute(rows, lambda q: q % 20 == 0, 200))


def test_nothing_to_search(table):
    df = table([(1, [0.0])], "vec_id long, embedding array<float>")
    assert nearest(df, df).count() == 0
    one = table([(1, [1.0])], "vec_id long, embedding array<float>")
    assert nearest(one, one).count() == 0
    assert nearest(one, df).count() == 0
