from __future__ import annotations

import zlib
from collections import defaultdict

import pytest
from conftest_llm import SF_MORE, read

from fhirlake.llm.shards import shard_by_bytes


def brute(rows, shards):
    """Sorted by key, cut by the middle of each row."""
    rows = sorted(((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    total, at, out, slots = sum(r[2] for r in rows), 0, [], defaultdict(int)
    for doc_id, crc, size in rows:
        shard = (2 * at + size) * shards // (2 * total)
        out.append((doc_id, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        at += size
    return sorted(out, key=str)


def mine(df, shards):
    return sorted((tuple(r) for r in shard_by_bytes(df, shards).collect()), key=str)


def test_given_documents(spark):
    rows = read(SF_MORE, "documents", "doc_id, text")
    got = mine(spark.read.parquet(f"{SF_MORE}/documents.parquet"), 16)
    assert got == brute(rows, 16)
    sizes = defaultdict(int)
    for r in got:
        sizes[r[4]] += r[1]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r[1] for r in got)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_edges(table, shards):
    rows = [(None, None), (None, "x"), (4, ""), (4, ""), (5, "é" * 100_000), (6, "a"), (6, "b")] + [(7, "same")] * 200
    df = table([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, size int, block string").repartition(5)
    assert mine(df, shards) == brute(rows, shards)


def test_empty_table(table):
    assert mine(table([], "doc_id long, text string"), 16) == []
