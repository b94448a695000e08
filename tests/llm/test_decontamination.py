from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import SF_MORE, read, shingles_of, similarity, words_of

from fhirlake.llm import decontamination
from fhirlake.llm.spans import U, multiset, occurrences


def brute(rows, items):
    """All windows of all items' sizes: (doc, item) -> (similarity, start)"""
    sets = {i: (len(w), shingles_of(w)) for i, t in items if (w := words_of(t))}
    by_shingle = defaultdict(set)
    for i, (_, shingles) in sets.items():
        for s in shingles:
            by_shingle[s].add(i)
    out = {}
    for doc, text in rows:
        words = words_of(text)
        for start in range(len(words)):
            for width in range(1, 6):
                for i in by_shingle.get(tuple(words[start : start + width]), ()):
                    n, shingles = sets[i]
                    if (n >= 5 and width < 5) or (n < 5 and (width != n or start + n > len(words))):
                        continue
                    s = 1.0 if n < 5 else similarity(shingles_of(words[start : start + n]), shingles)
                    if s >= 0.8 and (s, -start) > out.get((doc, i), (0, 0)):
                        out[doc, i] = (s, -start)
    return {k: (s, -start) for k, (s, start) in out.items()}


def mine(docs, benchmark, **settings):
    found = decontamination.contaminated(docs, benchmark, **settings).collect()
    assert len({(r["doc_id"], r["item_id"], bytes(r["node"])) for r in found}) == len(found)
    return {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["start"]) for r in found}


def test_given_documents(spark):
    got = mine(spark.read.parquet(f"{SF_MORE}/documents.parquet"), spark.read.parquet(f"{SF_MORE}/benchmark.parquet"))
    want = brute(read(SF_MORE, "documents", "doc_id, text"), read(SF_MORE, "benchmark", "item_id, text"))
    assert want and got == want


def test_planted_passages(table, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(2000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 8, 30, 60, 90])))) for i in range(40)]
    items += [(50, "only three words"), (51, None), (52, ""), (53, "?!"), (54, items[0][1]), (None, items[2][1])]
    rows = []
    for n in range(80):
        words = rng.choices(vocabulary, k=rng.randint(0, 300))
        passage = items[n % 40][1].split()
        for _ in range(rng.choice([0, 0, 1]) * len(passage) // 30):
            passage[rng.randrange(len(passage))] = "edited"
        at = rng.randint(0, len(words))
        rows.append((n, " ".join(words[:at] + passage[: rng.choice([999, 999, len(passage) * 9 // 10])] + words[at:])))
    rows += [(100, "There were ONLY three, words."), (101, "three words only"), (102, None), (103, ""), (103, ""), (104, items[5][1]), (104, items[5][1])]
    docs = table([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, start int")
    benchmark = table([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    want = brute(rows, items)
    assert mine(docs, benchmark) == want
    monkeypatch.setattr(decontamination, "SLICE_SHINGLES", 300)  # a benchmark larger than a slice
    assert mine(docs, benchmark) == want

    held = {i for i, _ in want}
    kept = decontamination.without_benchmark(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i not in held)


def test_empty_tables(table):
    docs = table([(1, "a b c d e f")], "doc_id long, text string")
    items = table([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.contaminated(docs, items).count() == 1
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert decontamination.without_benchmark(docs, items.limit(0)).count() == 1


def test_fingerprints_within_the_radius():
    rng = np.random.default_rng(1)
    n, off = 400, []
    for _ in range(n):
        common = rng.integers(0, 2**63, 80).astype(U)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, 10).astype(U)]) for _ in range(2))  # similarity 0.8
        owner, hashes, number = occurrences(np.repeat([0, 1], 90), np.concatenate([a, b]))
        prints = decontamination.simhash(owner, multiset(hashes, number), 2)
        off.append(int(np.bitwise_count(prints[0] ^ prints[1]).sum()))
    assert np.mean(np.array(off) <= decontamination.RADIUS) > 0.985


def test_columns_of_any_name_stay(table):
    item = "one two three four five six seven eight nine ten eleven twelve"
    names = "doc_id long, text string, row int, node string, __node string, item_id int"
    df = table([(1, f"so {item} so", 1, "a", "b", 3), (2, "nothing of the kind", 2, "c", "d", 4), (3, None, 3, "e", None, 5)], names)
    kept = decontamination.without_benchmark(df, table([(1, item)], "item_id long, text string"))
    assert kept.columns == df.columns
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in df.collect() if r["doc_id"] != 1}


def test_windows_meet_items_of_their_length_alone(table, monkeypatch):
    """Of the pairs that the blocks alone would compare, those of other lengths never meet."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    items = [(n, " ".join(rng.choices(words, k=12 + n % 60))) for n in range(120)]
    docs = table([(n, " ".join(rng.choices(words, k=20)) + " " + items[n % 120][1]) for n in range(240)], "doc_id long, text string")
    compared = []
    plain = type(docs).join

    def counted(self, other, on=None, how=None):
        if on == ["length", "block", "bits"]:
            compared.append((plain(self, other, on).count(), plain(self.drop("length"), other, on[1:]).count()))
        return plain(self, other, on, how) if how else plain(self, other, on)

    monkeypatch.setattr(type(docs), "join", counted)
    found = decontamination.contaminated(docs, table(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} >= {(n, n % 120) for n in range(240)}
    ((with_length, without),) = compared
    assert with_length * 2 <= without
