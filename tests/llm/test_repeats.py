from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from conftest_llm import SF, read

from fhirlake.llm.repeats import remove_repeats


def brute(rows, length=400):
    seen = Counter(b[i : i + length] for _, t in rows if (b := (t or "").encode()) for i in range(len(b) - length + 1))
    out = []
    for doc_id, text in rows:
        body, spans = (text or "").encode(), []
        for i in range(len(body) - length + 1):
            if seen[body[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        kept = b"".join(body[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(body)]))
        out.append((doc_id, len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def mine(df):
    found = remove_repeats(df, with_kept=False).collect()
    assert all(r["removed"] == (r["n_removed"] > 0) and len(r["spans"]) == r["n_spans"] for r in found)
    return sorted((tuple(r)[:5] for r in found), key=str)


def test_given_documents(spark):
    assert mine(spark.read.parquet(f"{SF}/documents.parquet")) == brute(read(SF, "documents", "doc_id, text"))


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages(table, seed):
    rng = random.Random(seed)
    base = "".join(rng.choices("abcde é\n", k=3000))
    rows = []
    for doc_id in range(40):
        text = "".join(rng.choices("abcdefgh ", k=rng.randint(0, 1500)))
        for _ in range(rng.randint(0, 3)):
            a, n, at = rng.randrange(2500), rng.choice([380, 399, 400, 401, 430, 900, 2000]), rng.randint(0, len(text))
            text = text[:at] + base[a : a + n] + text[at:]
        rows.append((doc_id, text))
    rows += [(100, "ab" * 1000), (101, "a" * 399), (102, "a" * 400), (103, "a" * 401), (104, "x" * 1000), (105, None), (106, "")]
    rows += [(107, base[:400]), (107, base[:400]), (None, base[1000:1500]), (108, "x" * 20_000)]
    df = table([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, row int, begin string")
    assert mine(df) == brute(rows)
    for r in remove_repeats(df).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
        assert sum(s["to"] - s["from"] for s in r["spans"]) == r["n_removed"]


def test_empty_table(table):
    assert mine(table([], "doc_id long, text string")) == []
