"""Token counts and packing against the libraries themselves."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest_llm import SF, read
from tokenizers import Tokenizer

from fhirlake.llm import encode, packing
from fhirlake.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGES = [
    (1, None), (2, ""), (3, " "), (4, "a  b"), (5, "x<|endoftext|>y <|endoftext|>"), (6, "tab\tand\n\n lines \n"),
    (7, "don't we'll é ü 日本語 🙂　 z"), (7, "don't we'll é ü 日本語 🙂　 z"), (None, "null key"), (8, "word " * 300_000), (9, "x" * 50_000),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture
def edges(table):
    rows = [(i, t, 0, "clash") for i, t in EDGES]
    return table(rows, "doc_id long, text string, n_tokens int, block string").repartition(3)


def test_pieces_give_the_library_s_ids(library, monkeypatch):
    rng = random.Random(4)
    blanks = [" ", "  ", "\n", "\t", " ", "\x1c", "　", "\x0b", "​", " \n", "\r\n", "\x85"]
    parts = ["a", "Zé", "1", "!", "'s", "'", "<|endoftext|>", "<|endo", "ü.", "日本", "🙂", "the", "%%%", "x|", "²", "ª", "à", "“", "–"]
    texts = ["".join(rng.choice(rng.choice([blanks, parts, parts])) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüéàçñ", k=rng.randint(1, 30))) for _ in range(20000)]
    for size in (1 << 22, 50):
        monkeypatch.setattr(encode, "BATCH_BYTES", size)
        some = texts if size > 50 else texts[:2000]
        counts, ids = encode.Encoder(PATH).batch(pa.array(some))
        want = [e.ids for e in library.encode_batch_fast(some, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want))
        assert np.array_equal(ids, np.concatenate(want))


def test_counts(spark, library):
    got = {r["doc_id"]: r for r in token_counts(spark.read.parquet(f"{SF}/documents.parquet"), PATH).collect()}
    for doc_id, text in read(SF, "documents", "doc_id, text"):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[doc_id]["n_bytes"], got[doc_id]["n_tokens"]) == (len(text.encode()), n)
        assert got[doc_id]["over_limit"] == (n > 1024)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_at_the_edges(edges, name):
    path = public_tokenizers.path(name)
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    want = sorted((str(i), len((t or "").encode()), count(t or "")) for i, t in EDGES)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts(edges, path).collect()) == want


def test_packing(edges, library):
    pieces = packing.pack(edges, PATH).cache()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in EDGES}
    windows, parts = defaultdict(list), defaultdict(list)
    for r in packing.digest(pieces).collect():
        own = np.array(ids[r["doc_id"]], "<u4")
        assert r["doc_tokens"] == len(own)
        assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"]].append((r["start"], r["length"]))
    assert sorted(windows) == list(range(len(windows)))
    for n, found in windows.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at == 2048 or n == max(windows)
    for doc_id, found in parts.items():
        copies = sum(i == doc_id for i, _ in EDGES)
        assert sum(length for _, length in found) == copies * len(ids[doc_id])

    whole = packing.sequences(pieces).orderBy("sequence_id").collect()
    stream = np.frombuffer(b"".join(r["ids"] for r in whole), "<u4")
    ends = np.flatnonzero(stream == 1)
    assert len(ends) == sum(i.count(1) for i, _ in ((ids[k], 0) for k, _ in EDGES))
    assert all(r["boundaries"][0]["offset"] == 0 for r in whole)


def test_empty_table(table):
    none = table([], "doc_id long, text string")
    assert token_counts(none, PATH).count() == 0
    assert packing.pack(none, PATH).count() == 0
