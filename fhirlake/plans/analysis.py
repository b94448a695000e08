"""The named analysis reports, on bronze and silver DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fhirlake.functions import rules
from fhirlake.operators import cohorts, profile

Tables = Mapping[str, DataFrame]

DIABETES = ("diabetes_t2", "diabetes_drug")
HYPERTENSION = ("hypertension", "antihypertensive")


def _flag(name: str) -> Column:
    return F.col("condition_flag") == name


def _hba1c(observations: DataFrame, plausible_only: bool = False) -> DataFrame:
    # The code alone decides the kind, so the filter can reach the scan.
    rows = observations.filter(F.col("loinc_code") == rules.HBA1C)
    return rows.filter("is_plausible_value") if plausible_only else rows


def _systolic(observations: DataFrame) -> DataFrame:
    return observations.filter((F.col("loinc_code") == rules.SYSTOLIC) & F.col("is_plausible_value"))


# --- layers and bronze profiles ---


def layer_counts(tables: Tables) -> DataFrame:
    return profile.layer_row_counts(tables)


def top_conditions(bronze_conditions: DataFrame, k: int = 10) -> DataFrame:
    return profile.top_k(bronze_conditions, "display", k)


def code_lookup(bronze_conditions: DataFrame, code: str) -> DataFrame:
    """Displays and systems a code is used with."""
    rows = bronze_conditions.filter(F.col("code") == code)
    return profile.distribution(rows, "display", "code", "code_system")


def top_drugs(bronze_medications: DataFrame, k: int = 20) -> DataFrame:
    return profile.top_k(bronze_medications, "medication_display", k)


def uncoded_drugs(bronze_medications: DataFrame, k: int = 10) -> DataFrame:
    rows = bronze_medications.filter(F.col("code_system").isNull())
    return profile.top_k(rows, "medication_display", k)


def targeted_drugs(bronze_medications: DataFrame) -> DataFrame:
    return profile.count_matching(bronze_medications, "medication_display", rules.TARGETED_DRUGS)


def unnamed_drug(bronze_medications: DataFrame) -> DataFrame:
    """First request without a drug name, to look up its document."""
    rows = bronze_medications.filter(F.col("medication_display").isNull())
    return profile.sample_rows(
        rows.select("medication_request_id", "patient_id"), 1, ["medication_request_id", "patient_id"]
    )


def value_types(bronze_observations: DataFrame) -> DataFrame:
    return profile.value_shape_counts(bronze_observations)


def top_observation_codes(bronze_observations: DataFrame, k: int = 15) -> DataFrame:
    return profile.top_k(bronze_observations, ["loinc_code", "loinc_display"], k)


def blood_pressure_counts(bronze_observations: DataFrame) -> DataFrame:
    rows = bronze_observations.filter(F.col("loinc_code").isin(rules.SYSTOLIC, rules.DIASTOLIC))
    return profile.distribution(rows, "loinc_code", "loinc_display")


# --- encounters and conditions ---


def inpatient_count(encounters: DataFrame) -> DataFrame:
    return profile.row_count(encounters, F.col("is_inpatient"))


def flag_distribution(df: DataFrame, flag: str) -> DataFrame:
    """Rows and patients per set flag."""
    return profile.distribution(df.filter(F.col(flag).isNotNull()), flag, distinct="patient_id")


def unknown_displays(conditions: DataFrame, k: int = 10) -> DataFrame:
    return profile.top_k(conditions.filter("clinical_category = 'unknown'"), "display", k)


def category_shares(conditions: DataFrame, digits: int = 6) -> DataFrame:
    category = F.col("clinical_category")
    wanted = ("disorder", "finding", "unknown")
    return profile.share(conditions, {f"{c}_share": category == c for c in wanted}, digits)


def chronic_cohorts(conditions: DataFrame) -> DataFrame:
    wanted = ("diabetes_t2", "hypertension", "heart_failure")
    return cohorts.cohort_sizes(conditions, {c: _flag(c) for c in wanted})


# --- treatment ---


def treated_patients(conditions: DataFrame, medications: DataFrame, pair: tuple[str, str]) -> DataFrame:
    """Patients with the condition who are on a drug for it."""
    condition, drug = pair
    return cohorts.cohort_overlap(
        conditions.filter(_flag(condition)), medications.filter(F.col("medication_flag") == drug)
    )


def diabetes_treatment_rate(conditions: DataFrame, medications: DataFrame, digits: int = 6) -> DataFrame:
    condition, drug = DIABETES
    rate = cohorts.treatment_rate(
        conditions, medications, _flag(condition), F.col("medication_flag") == drug
    )
    return rate.withColumn("rate", F.round("rate", digits))


# --- observations ---


def critical_by_kind(observations: DataFrame) -> DataFrame:
    return profile.distribution(observations.filter("is_critical_value"), "observation_kind")


def implausible_by_kind(observations: DataFrame) -> DataFrame:
    return profile.distribution(observations.filter(~F.col("is_plausible_value")), "observation_kind")


def diabetics_with_hba1c(conditions: DataFrame, observations: DataFrame) -> DataFrame:
    return cohorts.cohort_overlap(conditions.filter(_flag(DIABETES[0])), _hba1c(observations))


def hba1c_fanout(conditions: DataFrame, observations: DataFrame) -> DataFrame:
    """HbA1c over the plain join: a reading counts once per diabetes row of its patient."""
    stats = cohorts.fanout_stats(
        conditions.filter(_flag(DIABETES[0])), _hba1c(observations), "value_numeric"
    )
    return stats.select("min_value", "avg_value", "max_value", "readings")


def hba1c_summary(observations: DataFrame) -> DataFrame:
    """Plausible HbA1c readings of all patients."""
    return profile.numeric_summary(_hba1c(observations, True), "value_numeric")


def hba1c_by_unit(observations: DataFrame) -> DataFrame:
    return profile.numeric_summary(_hba1c(observations), "value_numeric", "unit")


def hba1c_bands(observations: DataFrame) -> DataFrame:
    return profile.band_counts(
        _hba1c(observations), "value_numeric", rules.HBA1C_EDGES, rules.HBA1C_LABELS, "a1c_band"
    )


def diabetic_hba1c(conditions: DataFrame, observations: DataFrame, plausible_only: bool) -> DataFrame:
    """HbA1c of the diabetes cohort, each reading once."""
    members = cohorts.cohort(conditions, _flag(DIABETES[0]))
    return cohorts.cohort_stats(_hba1c(observations, plausible_only), "value_numeric", members)


def systolic(conditions: DataFrame, observations: DataFrame, control: bool = False) -> DataFrame:
    """Plausible systolic readings of the hypertensive cohort, or of everybody else."""
    members = cohorts.cohort(conditions, _flag(HYPERTENSION[0]))
    return cohorts.cohort_stats(
        _systolic(observations), "value_numeric", members, control=control, digits=1
    )


def implausible_hba1c_share(observations: DataFrame, digits: int = 6) -> DataFrame:
    return profile.share(
        _hba1c(observations), {"implausible_share": ~F.col("is_plausible_value")}, digits
    )
