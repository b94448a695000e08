"""Data-quality checks whose outcomes are rows.

Column tests count offending rows. Scalar checks compare one figure with bounds. Both
are batched: tests of one table that need no grouping share a single pass over it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

log = logging.getLogger(__name__)

UNIQUE, NOT_NULL, ACCEPTED, FOREIGN_KEY = "unique", "not_null", "accepted_values", "relationships"


@dataclass(frozen=True)
class ColumnTest:
    """One test of one column; ``values`` for accepted values, ``parent`` for a foreign key."""

    model: str
    column: str
    kind: str
    values: tuple[str, ...] = ()
    where: str | None = None
    parent: tuple[str, str] | None = None


def _not_null(test: ColumnTest) -> Column:
    return F.col(test.column).isNull()


def _not_accepted(test: ColumnTest) -> Column:
    """NULL is neither in nor out of a list, so it does not offend."""
    outside = ~F.col(test.column).isin(*test.values)
    return outside if test.where is None else F.expr(test.where) & outside


_ROW_TESTS: dict[str, Callable[[ColumnTest], Column]] = {NOT_NULL: _not_null, ACCEPTED: _not_accepted}


def _row_test_counts(df: DataFrame, tests: Sequence[ColumnTest]) -> DataFrame:
    """All row-wise tests of a table in one pass, one output row per test."""
    counts = df.agg(
        *[F.count_if(_ROW_TESTS[t.kind](t)).alias(f"t{i}") for i, t in enumerate(tests)]
    )
    rows = [
        F.struct(
            F.lit(t.model).alias("model"),
            F.lit(t.column).alias("column_name"),
            F.lit(t.kind).alias("test"),
            F.col(f"t{i}").alias("violations"),
        )
        for i, t in enumerate(tests)
    ]
    return counts.select(F.inline(F.array(*rows)))


def _labelled(violations: DataFrame, test: ColumnTest) -> DataFrame:
    return violations.select(
        F.lit(test.model).alias("model"),
        F.lit(test.column).alias("column_name"),
        F.lit(test.kind).alias("test"),
        "violations",
    )


def duplicate_keys(df: DataFrame, column: str) -> DataFrame:
    """Values held by more than one row, NULL aside."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )


def orphan_keys(child: DataFrame, parent: DataFrame, column: str, parent_column: str | None = None) -> DataFrame:
    """Child key values without a parent, and their number of rows.

    Child rows are counted per key before the join, so a key with very many rows is one row.
    """
    keys = parent.select(F.col(parent_column or column).alias(column)).distinct()
    return (
        child.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(keys, column, "left_anti")
    )


def expect_unique(df: DataFrame, column: str) -> DataFrame:
    """Number of duplicated key values."""
    return duplicate_keys(df, column).agg(F.count(F.lit(1)).alias("violations"))


def expect_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("violations"))


def expect_in(df: DataFrame, column: str, values: Sequence[str], where: str | None = None) -> DataFrame:
    test = ColumnTest("", column, ACCEPTED, tuple(values), where)
    return df.agg(F.count_if(_not_accepted(test)).alias("violations"))


def expect_fk(child: DataFrame, parent: DataFrame, column: str, parent_column: str | None = None) -> DataFrame:
    """Number of child rows whose key has no parent."""
    return orphan_keys(child, parent, column, parent_column).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("violations")
    )


def expect_agree(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Number of rows on which two columns differ; a NULL on either side is skipped."""
    return df.agg(F.count_if(a != b).alias("violations"))


def expect_count(df: DataFrame, n: int) -> DataFrame:
    """Row count against the expected one."""
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(n).cast("long").alias("expected"), (F.col("n") == n).alias("passed")
    )


def column_test_report(tables: Mapping[str, DataFrame], tests: Sequence[ColumnTest]) -> DataFrame:
    """(model, column_name, test, violations) of every test, as one lazy DataFrame."""
    parts: list[DataFrame] = []
    for model in dict.fromkeys(t.model for t in tests):
        row_tests = [t for t in tests if t.model == model and t.kind in _ROW_TESTS]
        if row_tests:
            parts.append(_row_test_counts(tables[model], row_tests))
    for test in tests:
        if test.kind == UNIQUE:
            parts.append(_labelled(expect_unique(tables[test.model], test.column), test))
        elif test.kind == FOREIGN_KEY:
            parent, column = test.parent
            counted = expect_fk(tables[test.model], tables[parent], test.column, column)
            parts.append(_labelled(counted, test))
    return reduce(DataFrame.unionByName, parts)


def tested_columns(tests: Sequence[ColumnTest]) -> dict[str, list[str]]:
    """Per table the columns that `column_test_report` reads, parents' keys among them.

    A table that is written for the tests alone needs no others. A ``where`` is taken to read its test's own column.
    """
    read: dict[str, dict[str, None]] = {}
    for test in tests:
        read.setdefault(test.model, {})[test.column] = None
        if test.parent is not None:
            read.setdefault(test.parent[0], {})[test.parent[1]] = None
    return {model: list(columns) for model, columns in read.items()}


@dataclass(frozen=True)
class Check:
    """A scalar that has to lie within bounds.

    ``value`` is an aggregate column over ``table``, or a function from the tables to a
    one-row DataFrame for figures that need a join or a grouping: its first column, or ``column``. Checks
    with the same function share one run of it.
    """

    name: str
    value: Column | Callable[[Mapping[str, DataFrame]], DataFrame]
    table: str | None = None
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False
    notes: str = ""
    column: str | None = None

    @property
    def expected(self) -> str:
        if self.low is not None and self.low == self.high:
            return f"== {self.low}"
        if self.low is None:
            return f"{'<' if self.high_open else '<='} {self.high}"
        if self.high is None:
            return f"{'>' if self.low_open else '>='} {self.low}"
        return f"{self.low} .. {self.high}"

    def passes(self, value: Column) -> Column:
        """False also for a missing value."""
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & ((value > self.low) if self.low_open else (value >= self.low))
        if self.high is not None:
            inside = inside & ((value < self.high) if self.high_open else (value <= self.high))
        return F.coalesce(inside, F.lit(False))


def _report_row(check: Check, value: Column) -> Column:
    value = value.cast("double")
    return F.struct(
        F.lit(check.name).alias("check_name"),
        value.alias("value"),
        F.lit(check.expected).alias("expected"),
        check.passes(value).alias("passed"),
        F.lit(check.notes).alias("notes"),
        F.lit(None).cast("string").alias("error"),
    )


def _batch_report(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    figures = df.agg(*[c.value.alias(f"c{i}") for i, c in enumerate(checks)])
    rows = [_report_row(c, F.col(f"c{i}")) for i, c in enumerate(checks)]
    return figures.select(F.inline(F.array(*rows)))


def _shared_report(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    figure = checks[0].value(tables)
    return figure.select(F.inline(F.array(*[_report_row(c, F.col(c.column or figure.columns[0])) for c in checks])))


def _batches(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> Iterable[tuple[list[Check], Callable[[], DataFrame]]]:
    for table in dict.fromkeys(c.table for c in checks if c.table is not None):
        batch = [c for c in checks if c.table == table]
        yield batch, lambda table=table, batch=batch: _batch_report(tables[table], batch)
    for value in dict.fromkeys(c.value for c in checks if c.table is None):
        batch = [c for c in checks if c.table is None and c.value is value]
        yield batch, lambda batch=batch: _shared_report(tables, batch)


def suite_report(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """Every check as a row, as one lazy DataFrame; checks on one table share one pass."""
    return reduce(DataFrame.unionByName, [build() for _, build in _batches(tables, checks)])


REPORT_SCHEMA = "check_name string, value double, expected string, passed boolean, notes string, error string"


def run_suite(spark: SparkSession, tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """Run every check; one that cannot be computed is a failed row with its error.

    A failing batch is run again check by check, so that one broken check does not hide
    the others. Only the figures, one row per check, come to the driver.
    """
    rows: list[tuple] = []

    def broken(check: Check, error: Exception) -> None:
        log.warning("check %s failed to run: %s", check.name, error)
        text = f"{type(error).__name__}: {error}".splitlines()[0]
        rows.append((check.name, None, check.expected, False, check.notes, text))

    for batch, build in _batches(tables, checks):
        try:
            rows.extend(tuple(r) for r in build().collect())
        except (PySparkException, KeyError) as error:
            if len(batch) == 1:
                broken(batch[0], error)
                continue
            for check in batch:
                try:
                    alone = _batch_report(tables[check.table], [check]) if check.table else _shared_report(tables, [check])
                    rows.extend(tuple(r) for r in alone.collect())
                except (PySparkException, KeyError) as single_error:
                    broken(check, single_error)
    order = {c.name: i for i, c in enumerate(checks)}
    rows.sort(key=lambda r: order[r[0]])
    return spark.createDataFrame(rows, REPORT_SCHEMA)


class SuiteFailed(RuntimeError):
    """Raised with the names of all failed checks."""


def assert_suite(report: DataFrame) -> None:
    failed = [r.check_name for r in report.filter(~F.col("passed")).select("check_name").collect()]
    if failed:
        raise SuiteFailed(f"{len(failed)} checks failed: {', '.join(failed)}")
