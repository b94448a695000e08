from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import SF_MORE, read, shingles_of, similarity, words_of

from fhirlake.llm import near_duplicates
from fhirlake.llm.spans import U, mix, multiset, occurrences


def brute(rows):
    """class per row, by comparing all texts that share a shingle"""
    texts = {}
    for n, (_, text) in enumerate(rows):
        words = tuple(words_of(text))
        texts.setdefault(words, []).append(n)
    nodes = [w for w in texts if w]
    sets = {w: shingles_of(list(w)) for w in nodes}
    by_shingle = defaultdict(list)
    for w in nodes:
        for s in sets[w]:
            by_shingle[s].append(w)
    parent = {w: w for w in nodes}

    def find(w):
        while parent[w] != w:
            w = parent[w]
        return w

    tested = set()
    for group in by_shingle.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if (a, b) not in tested:
                    tested.add((a, b))
                    if similarity(sets[a], sets[b]) >= 0.8:
                        parent[find(a)] = find(b)
    name = {}
    for w in nodes:
        ids = [rows[n][0] for n in texts[w] if rows[n][0] is not None]
        if ids:
            name[find(w)] = min(name.get(find(w), ids[0]), *ids)
    return Counter((i, name.get(find(w)) if (w := tuple(words_of(t))) else i) for i, t in rows)


def mine(df):
    return Counter((r["doc_id"], r["class_id"]) for r in near_duplicates.classes(df).collect())


def test_given_documents(spark):
    rows = read(SF_MORE, "documents", "doc_id, text")
    assert mine(spark.read.parquet(f"{SF_MORE}/documents.parquet")) == brute(rows)


def test_planted_copies(table):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    rows, passage = [], rng.choices(vocabulary, k=60)
    for base in range(40):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 60, 400]))
        for copy in range(rng.randint(1, 6)):
            edited = list(words)
            for _ in range(rng.randint(0, 3) * len(words) // 150):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((len(rows), (" ,  " if copy % 2 else " ").join(edited).upper() if copy == 2 else " ".join(edited)))
        rows.append((len(rows), " ".join(rng.choices(vocabulary, k=80) + passage)))
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (None, "alone here"), (None, None), (900, ""), (901, "!?"), (901, "!?")]
    rows += [(950, "same " * 5000), (951, "same " * 5001), (952, "same " * 20)]
    df = table([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, band int")
    assert mine(df) == brute(rows)


def test_keep_one(table):
    rows = [(2, "One two three four five six."), (1, "one two three four five six"), (3, "other"), (3, "other"), (None, "other")]
    rows += [(None, None), (5, ""), (5, ""), (None, "x y"), (None, "x y")]
    df = table([(i, t, "clash") for i, t in rows], "doc_id long, text string, component string")
    kept = near_duplicates.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    want = [(1, "one two three four five six"), (3, "other"), (None, None), (5, ""), (5, ""), (None, "x y")]
    assert got == sorted(want, key=str)


def test_empty_table(table):
    df = table([], "doc_id long, text string")
    assert near_duplicates.classes(df).count() == 0
    assert near_duplicates.keep_one(df).count() == 0


@pytest.mark.parametrize("shared", [0.0, 0.5, 0.8, 0.95])
def test_signatures_agree_as_often_as_sets_are_alike(shared):
    rng = np.random.default_rng(3)
    common = int(1000 * shared)
    a = rng.integers(0, 2**63, 1000).astype(U)
    b = np.concatenate([a[:common], rng.integers(0, 2**63, 1000 - common).astype(U)])
    b = np.concatenate([b, b[:300]])  # weights above one
    owner, hashes, number = occurrences(np.repeat([0, 1], [1000, 1300]), np.concatenate([a, b]))
    found = near_duplicates.dart_signatures(owner, multiset(hashes, number), 2, 4096)
    x, y = multiset(*occurrences(np.zeros(1000, int), a)[1:]), multiset(*occurrences(np.zeros(1300, int), b)[1:])
    want = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((found[0] == found[1]).mean() - want) < 0.03
    assert mix(np.arange(3, dtype=U)).dtype == U


def test_columns_of_any_name_stay(table):
    text = "one two three four five six seven eight nine ten"
    names = "doc_id long, text string, row int, node string, __node string, lost_id int"
    df = table([(n, text if n < 3 else f"{text} {n}" * n, n, "a", "b", 7) for n in range(5)], names)
    kept = near_duplicates.keep_one(df)
    assert kept.columns == df.columns
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in df.collect() if r["doc_id"] not in (1, 2)}
