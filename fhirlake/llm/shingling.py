"""Normal forms of texts and weighted similarity on word shingles, on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 5
SIMILARITY = 0.8


def normal(text: Column) -> Column:
    """Lower-case words (runs of letters, marks and digits) with single blanks between; null becomes empty."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.trim(words)


def text_key(normal_text: Column) -> Column:
    """Names a normal text; null for one without words."""
    return F.when(normal_text != "", F.unhex(F.md5(normal_text)))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two multisets, given as sets of numbered occurrences (see `spans.multiset`)."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)
