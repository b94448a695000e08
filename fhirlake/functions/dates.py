"""Date differences that count calendar boundaries, and date text that must be complete."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def years_between(start: Column, end: Column) -> Column:
    """Year boundaries crossed (31 Dec -> 1 Jan is one)."""
    return (F.year(end) - F.year(start)).cast("long")


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed (00:00:59 -> 00:01:00 is one)."""
    return F.timestamp_diff(
        "MINUTE", F.date_trunc("MINUTE", start), F.date_trunc("MINUTE", end)
    ).cast("long")


def days_between(start: Column, end: Column) -> Column:
    """Midnights crossed."""
    return F.datediff(end.cast("date"), start.cast("date")).cast("long")


def has_full_date(text: Column) -> Column:
    """Text starts like yyyy-m-d; Spark's own cast would also take '2012' and '2012-05'."""
    date = F.ltrim(text)
    return (F.locate("-", date) == 5) & F.locate("-", date, 6).between(7, 8)
