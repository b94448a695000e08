"""Generic rule-driven classifiers; the first matching rule of a list wins.

Every classifier compiles to one JVM expression chain, so it stays inside code
generation and costs neither a join nor a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chain(branches: Iterable[tuple[Column, object]], default: object) -> Column:
    fallback = F.lit(default) if default is not None else F.lit(None).cast("string")
    chain = None
    for condition, label in branches:
        chain = F.when(condition, F.lit(label)) if chain is None else chain.when(condition, F.lit(label))
    return fallback if chain is None else chain.otherwise(fallback)


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def code_in(col: Column, codes: Sequence[str]) -> Column:
    return col.isin(*codes)


def suffix_match(col: Column, *suffixes: str) -> Column:
    """Case-insensitive, end-anchored, no trimming; NULL for NULL text."""
    lowered = F.lower(col)
    return _any([lowered.endswith(s.lower()) for s in suffixes])


def contains_any(col: Column, words: Sequence[str]) -> Column:
    """Case-insensitive substring test; NULL for NULL text."""
    lowered = F.lower(col)
    return _any([lowered.contains(w.lower()) for w in words])


def classify_map(col: Column, mapping: Mapping[str, str], default: str | None) -> Column:
    return _chain(((col == key, label) for key, label in mapping.items()), default)


def classify_codes(col: Column, sets: Sequence[tuple[Sequence[str], str]], default: str | None) -> Column:
    return _chain(((code_in(col, codes), label) for codes, label in sets), default)


def classify_suffix(col: Column, rules: Sequence[tuple[str, str]], default: str | None) -> Column:
    return _chain(((suffix_match(col, suffix), label) for suffix, label in rules), default)


def classify_contains(col: Column, rules: Sequence[tuple[Sequence[str], str]], default: str | None) -> Column:
    return _chain(((contains_any(col, words), label) for words, label in rules), default)


_COMPARE: dict[str, Callable[[Column, float], Column]] = {
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
}


def range_rule(code: Column, value: Column, rule: tuple[str, str, float]) -> Column:
    """One (code, comparison, bound) rule as a predicate."""
    wanted, comparison, bound = rule
    return (code == wanted) & _COMPARE[comparison](value, float(bound))


def flag_ranges(code: Column, value: Column, rules: Sequence[tuple[str, str, float]]) -> Column:
    """True when any rule fires, else False; never NULL, also for a NULL value."""
    return F.coalesce(_any([range_rule(code, value, r) for r in rules]), F.lit(False))


def band(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Half-open bands: ``labels[i]`` below ``edges[i]``, the last label above all edges."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than edges")
    return _chain(((col < float(e), label) for e, label in zip(edges, labels)), labels[-1])
