from __future__ import annotations

import zlib
from collections import defaultdict
from hashlib import sha256

import pyarrow as pa
import pytest
from conftest_llm import SF_MORE, read
from pyspark.sql import functions as F

from fhirlake.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
TAMPERED = "crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        own = sorted((r[0] is not None, r[0] or 0, leaf_of(r), r) for r in groups[source])
        trees.append((own, levels([x[2] for x in own])))
    top = levels([tree[-1][0] for _, tree in trees])
    root, out = top[-1][0], []
    for place, (own, tree) in enumerate(trees):
        for i, (_, _, leaf, row) in enumerate(own):
            digest, siblings = leaf, []
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                digest = leaf_of((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for nodes, at in ((tree, i), (top, place)):
                for level in nodes[:-1]:
                    run, slot = level[at // 16 * 16 :][:16], at % 16
                    siblings += run[:slot] + run[slot + 1 :]
                    digest = h(*run[:slot], digest, *run[slot + 1 :])
                    at //= 16
            out.append((row[0], leaf, tree[-1][0], root, h(*siblings), digest, digest == root))
    return sorted(out, key=str)


def mine(df):
    return sorted((tuple(r) for r in merkle.manifest(df, tampered=F.expr(TAMPERED)).collect()), key=str)


def edges():
    rows = [(i, None if i % 7 == 0 else f"s{i % 300}" if i % 3 else "hot", None, i, None if i % 11 == 0 else f"Text {i}") for i in range(3000)]
    return rows + [(None, "", "en", 1, "")] * 3 + [(5, "z", "a", None, "B")] * 20 + [(9, "long", "é", 2, "Aé" * 200_000)]


def test_given_documents(spark):
    got = mine(spark.read.parquet(f"{SF_MORE}/documents.parquet"))
    assert got == brute(read(SF_MORE, "documents", "doc_id, source, lang, n_chars, text"))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_edges_in_units_of_any_height(table, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "SPAN", 16**height)
    rows = edges()
    df = table([(*r, 1, "x") for r in rows], f"{SCHEMA}, idx int, tree string").repartition(5)
    assert mine(df) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17])
def test_few_rows(table, n):
    rows = [(i, f"s{i}" if n == 2 else None, None, None, "X") for i in range(n)]
    assert mine(table(rows, SCHEMA)) == brute(rows)


def test_empty_table(table):
    assert mine(table([], SCHEMA)) == []


def test_queue_holds_few_messages(monkeypatch):
    """The forward sweep meets a whole unit, but its queue stays within 16 messages a level."""
    most, push = 0, merkle.heapq.heappush

    def watched(queue, item):
        nonlocal most
        push(queue, item)
        most = max(most, len(queue))

    monkeypatch.setattr(merkle.heapq, "heappush", watched)
    n = merkle.SPAN
    columns = [pa.array(["t"] * n), pa.array([n] * n), pa.array(range(n)), pa.array(["0" * 64] * n)]
    batch = pa.RecordBatch.from_arrays(columns, ["tree", "total", "idx", "digest"])
    made = sum(b.num_rows for b in merkle.forward(iter([batch.slice(0, 1000), batch.slice(1000)])))
    assert made == 256 + 16 + 1
    assert most <= 16 * merkle.HEIGHT
