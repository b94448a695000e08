"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def likely(draw: str, rows: int, total: int) -> Column:
    """Whether a row with this hash may be among the `rows` of `total` that are drawn; leaves about twice as many."""
    if total <= 2 * rows:
        return F.lit(True)
    return F.pmod(F.col(draw), F.lit(1 << 40)) < int((1 << 40) * 2 * rows / total)


def drawn(df: DataFrame, rows: int, total: int, *columns: str) -> DataFrame:
    """`rows` of the `total` rows (all, if fewer), drawn by a hash of the columns.

    A filter on the hash leaves about twice as many, so that what moves does not grow with the number of tasks.
    """
    draw = F.xxhash64(F.lit(7), *columns)
    some = df
    if total > 2 * rows:
        some = df.filter(F.pmod(draw, F.lit(1 << 40)) < int((1 << 40) * 2 * rows / total))
    return some.orderBy(draw, *columns).limit(rows)
