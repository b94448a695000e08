"""Cohorts, control groups and figures over them.

Figures are first reduced to one row per entity (a map-side aggregate), and only those
rows are joined. A patient with a third of all readings is then one row, joins on a
duplicated side are products of counts instead of emitted pairs, and distinct patients
are a plain row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATIENT = "patient_id"


def cohort(df: DataFrame, condition: Column, key: str = PATIENT) -> DataFrame:
    """Distinct keys of the rows meeting the condition (a missing key counts as one)."""
    return df.filter(condition).select(key).distinct()


def members(df: DataFrame, condition: Column, key: str = PATIENT) -> DataFrame:
    """Keys of the rows meeting the condition, as often as they occur.

    For joins of rows against a cohort: an aggregate between shuffle and sort, as `cohort` has it, would keep
    adaptive execution from splitting a hot key of the other side.
    """
    return df.filter(condition).select(key)


def in_cohort(df: DataFrame, members: DataFrame, key: str = PATIENT) -> DataFrame:
    return df.join(members, key, "left_semi")


def not_in_cohort(df: DataFrame, members: DataFrame, key: str = PATIENT) -> DataFrame:
    """Control group: all rows whose key is not in the cohort, also those without a key."""
    return df.join(members, key, "left_anti")


def cohort_overlap(a: DataFrame, b: DataFrame, key: str = PATIENT, name: str = "patients") -> DataFrame:
    """Number of keys present on both sides."""
    return (
        cohort(a, F.lit(True), key)
        .join(cohort(b, F.lit(True), key), key, "left_semi")
        .agg(F.count(F.lit(1)).alias(name))
    )


def per_entity(df: DataFrame, value: str, key: str = PATIENT) -> DataFrame:
    """Mergeable figures of a value, one row per key."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("readings"),
        F.count(value).alias("valued"),
        F.sum(value).alias("total"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )


def _summary(entities: DataFrame, key: str, digits: int, weight: Column | None = None) -> DataFrame:
    weight = F.lit(1).cast("long") if weight is None else weight
    mean = F.try_divide(F.sum(F.col("total") * weight), F.sum(F.col("valued") * weight))
    return entities.agg(
        F.count(key).alias("patients"),
        F.coalesce(F.sum(F.col("readings") * weight), F.lit(0)).alias("readings"),
        F.round(mean, digits).alias("avg_value"),
        F.round(F.min("low"), digits).alias("min_value"),
        F.round(F.max("high"), digits).alias("max_value"),
    )


def cohort_stats(
    df: DataFrame,
    value: str,
    members: DataFrame | None = None,
    control: bool = False,
    key: str = PATIENT,
    digits: int = 2,
) -> DataFrame:
    """Patients, readings, mean, min and max of the cohort's rows (or of its controls)."""
    entities = per_entity(df, value, key)
    if members is not None:
        entities = (not_in_cohort if control else in_cohort)(entities, members, key)
    return _summary(entities, key, digits)


def fanout_stats(
    rows: DataFrame, readings: DataFrame, value: str, key: str = PATIENT, digits: int = 2
) -> DataFrame:
    """Figures of the plain inner join, where each reading counts once per matching row.

    Kept as a contrast to `cohort_stats`; the multiplied rows are never produced.
    """
    copies = rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    joined = per_entity(readings, value, key).join(copies, key)
    return _summary(joined, key, digits, F.col("copies"))


def treatment_rate(
    conditions: DataFrame,
    medications: DataFrame,
    has_condition: Column,
    has_drug: Column,
    key: str = PATIENT,
) -> DataFrame:
    """Patients with the condition, those of them on the drug, and the share."""
    members = cohort(conditions, has_condition, key)
    drug_users = cohort(medications, has_drug, key).withColumn("treated", F.lit(True))
    counts = members.join(drug_users, key, "left").agg(
        F.count(F.lit(1)).alias("patients"), F.count("treated").alias("treated_patients")
    )
    return counts.withColumn(
        "rate", F.try_divide(F.col("treated_patients").cast("double"), F.col("patients"))
    )


def cohort_sizes(df: DataFrame, conditions: dict[str, Column], key: str = PATIENT) -> DataFrame:
    """Distinct keys per condition, all in one pass over the rows."""
    flags = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.bool_or(c).alias(name) for name, c in conditions.items()]
    )
    return flags.agg(*[F.count_if(name).alias(name) for name in conditions])


def rows_per_entity(df: DataFrame, condition: Column, key: str = PATIENT, digits: int = 2) -> DataFrame:
    """Rows, distinct keys and rows per key of the rows meeting the condition."""
    members = (
        df.filter(condition & F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    )
    counts = members.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("patients")
    )
    ratio = F.try_divide(F.col("rows").cast("double"), F.col("patients"))
    return counts.withColumn("rows_per_patient", F.round(ratio, digits))


def flagged_share(df: DataFrame, condition: Column, population: DataFrame, key: str = PATIENT) -> DataFrame:
    """Share of the population's distinct keys that have a row meeting the condition."""
    flagged = cohort(df, condition, key).withColumn("flagged", F.lit(True))
    counts = cohort(population, F.lit(True), key).join(flagged, key, "left").agg(
        F.count(key).alias("patients"), F.count("flagged").alias("flagged_patients")
    )
    share = F.try_divide(F.col("flagged_patients").cast("double"), F.col("patients"))
    return counts.withColumn("share", F.round(share, 4))
