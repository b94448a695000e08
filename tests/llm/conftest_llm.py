"""Brute-force helpers of these tests."""

from __future__ import annotations

import re
from collections import Counter

import duckdb

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"


def read(sf_dir: str, name: str, columns: str) -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{sf_dir}/{name}.parquet' ORDER BY 1").fetchall()


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles_of(words: list[str], width: int = 5) -> Counter:
    if len(words) < width:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)
