"""Counts, distributions, top lists and numeric summaries of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fhirlake.functions.classify import band


def row_count(df: DataFrame, condition: Column | None = None) -> DataFrame:
    return (df if condition is None else df.filter(condition)).agg(F.count(F.lit(1)).alias("n"))


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys; equal on a deduplicated table."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("unique_keys"))


def distribution(
    df: DataFrame, *columns: str, distinct: str | None = None, distinct_name: str = "patients"
) -> DataFrame:
    """Rows (and distinct values of another column) per group, most frequent first."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    if distinct is not None:
        aggregates.append(F.countDistinct(distinct).alias(distinct_name))
    ties = [F.asc_nulls_last(c) for c in columns]
    return df.groupBy(*columns).agg(*aggregates).orderBy(F.desc("n"), *ties)


def top_k(df: DataFrame, columns: str | Sequence[str], k: int) -> DataFrame:
    """The k most frequent groups; equal counts are settled by the group values."""
    names = [columns] if isinstance(columns, str) else list(columns)
    return distribution(df, *names).limit(k)


def share(df: DataFrame, conditions: Mapping[str, Column], digits: int | None = None) -> DataFrame:
    """Share of rows meeting each condition, all in one pass; NULL for an empty table."""
    shares = []
    for name, condition in conditions.items():
        ratio = F.try_divide(F.count_if(condition).cast("double"), F.count(F.lit(1)))
        shares.append((ratio if digits is None else F.round(ratio, digits)).alias(name))
    return df.agg(*shares)


def numeric_summary(
    df: DataFrame, column: str, by: str | Sequence[str] | None = None, digits: int = 2
) -> DataFrame:
    """Rows, min, mean and max of a column, per group or overall."""
    groups = [] if by is None else [by] if isinstance(by, str) else list(by)
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.min(column), digits).alias("min_value"),
        F.round(F.avg(column), digits).alias("avg_value"),
        F.round(F.max(column), digits).alias("max_value"),
    )


def band_counts(
    df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str], name: str = "band"
) -> DataFrame:
    """Rows with a value per half-open band, ordered by label."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(band(F.col(column), edges, labels).alias(name))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(name)
    )


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns]
    )


def value_shape_counts(observations: DataFrame) -> DataFrame:
    """Rows carrying each kind of value; sums, so NULL on an empty table."""

    def present(column: str) -> Column:
        return F.sum(F.when(F.col(column).isNotNull(), 1).otherwise(0))

    return observations.agg(
        F.count(F.lit(1)).alias("total"),
        present("value_numeric").alias("numeric_rows"),
        present("value_text").alias("text_rows"),
        present("value_code").alias("coded_rows"),
        present("parent_observation_id").alias("component_rows"),
    )


def pair_balance(df: DataFrame, column: str, first: str, second: str) -> DataFrame:
    """Rows of two codes that must come in pairs, and whether they are equally many."""
    counts = df.agg(
        F.count_if(F.col(column) == first).alias("first_rows"),
        F.count_if(F.col(column) == second).alias("second_rows"),
    )
    return counts.withColumn("balanced", F.col("first_rows") == F.col("second_rows"))


def count_matching(df: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    """Rows whose text contains each word, ignoring case; one pass for all words."""
    lowered = F.lower(F.col(column))
    counts = df.agg(*[F.count_if(lowered.contains(w.lower())).alias(f"w{i}") for i, w in enumerate(words)])
    rows = [F.struct(F.lit(w).alias("word"), F.col(f"w{i}").alias("n")) for i, w in enumerate(words)]
    return counts.select(F.inline(F.array(*rows)))


def layer_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Labelled row counts, ordered by label."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("table_name")


def sample_rows(df: DataFrame, n: int, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """A few rows to look at; with an order, always the same ones."""
    if order_by is not None:
        names = [order_by] if isinstance(order_by, str) else list(order_by)
        df = df.orderBy(*[F.asc_nulls_last(c) for c in names])
    return df.limit(n)
