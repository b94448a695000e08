from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import SF_MORE, read

from fhirlake.llm import importance, prefix_crc

BUCKETS = 10_000


def features(text):
    lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % BUCKETS for n in (1, 2) for i in range(len(w) - n + 1)]


def brute(docs, target):
    found = [features(t) for _, t in docs]
    s = Counter(b for _, f in found for b in f)
    t = Counter(b for text in target for b in features(text)[1])
    all_s, all_t = sum(s.values()) + BUCKETS, sum(t.values()) + BUCKETS
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(BUCKETS)]
    rows = []
    for (key, _), (words, f) in zip(docs, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(f), weight, score, None, words])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(able[: 25 * len(able) // 100]):
        row[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def mine(docs, target):
    return sorted((tuple(r) for r in importance.resample(docs, target).collect()), key=str)


def test_given_documents(spark):
    docs, target = (spark.read.parquet(f"{SF_MORE}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [t for (t,) in read(SF_MORE, "benchmark", "text")]
    assert mine(docs, target) == brute(read(SF_MORE, "documents", "doc_id, text"), texts)


def test_edges(table):
    some = [f"Word{i % 7} ÉTÉ été, x-y 'z' {i} 日本 語\x7f" for i in range(60)]
    texts = [None, "", "...", "a", "A a", " a  b ", "end", "end.", "long word " * 60_000, *some, *[" ".join(some)] * 40, " ".join(some).upper()]
    docs = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(70, " ".join(some))] * 3
    target = ["Word1 x", None, "", "日本 語 word2 " * 30]
    wide = table([(i, t, 1, "b") for i, t in docs], "doc_id long, text string, weight int, rank string").repartition(4)
    assert mine(wide, table([(t, 1) for t in target], "text string, item_id int")) == brute(docs, target)


def test_empty_tables(table):
    none, docs = table([], "doc_id long, text string"), [(i, "one two " * 20) for i in range(8)]
    assert mine(none, none) == []
    assert mine(table(docs, "doc_id long, text string"), none) == brute(docs, [])


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 1024, 100_000])
def test_every_part_has_its_crc(n):
    rng = np.random.default_rng(n)
    raw = rng.integers(0, 256, n).astype(np.uint8)
    ends = np.sort(rng.integers(0, n + 1, (2, 200)), 0)
    got = prefix_crc.between(prefix_crc.running(raw), ends[0], ends[1])
    assert got.tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(*ends)]
