"""The silver contract: column tests of the five models and the distribution suite."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fhirlake.operators import cohorts
from fhirlake.operators.quality import ACCEPTED, FOREIGN_KEY, NOT_NULL, UNIQUE, Check, ColumnTest

PARENT = ("silver_patients", "patient_id")


def _model(name: str, key: str, required: tuple[str, ...], child: bool = True) -> list[ColumnTest]:
    tests = [ColumnTest(name, key, UNIQUE), ColumnTest(name, key, NOT_NULL)]
    if child:
        tests.append(ColumnTest(name, "patient_id", NOT_NULL))
        tests.append(ColumnTest(name, "patient_id", FOREIGN_KEY, parent=PARENT))
    return tests + [ColumnTest(name, column, NOT_NULL) for column in required]


def _accepted(name: str, column: str, values: tuple[str, ...], nullable: bool = False) -> ColumnTest:
    where = f"{column} IS NOT NULL" if nullable else None
    return ColumnTest(name, column, ACCEPTED, values, where)


# Required columns and accepted values.
COLUMN_TESTS: list[ColumnTest] = [
    *_model("silver_patients", "patient_id", ("birth_date", "is_deceased"), child=False),
    _accepted("silver_patients", "gender", ("male", "female", "other", "unknown")),
    *_model("silver_encounters", "encounter_id", ("is_inpatient",)),
    _accepted(
        "silver_encounters", "encounter_type", ("ambulatory", "emergency", "inpatient", "home_health", "virtual")
    ),
    *_model("silver_conditions", "condition_id", ("snomed_code", "is_billable_diagnosis")),
    _accepted("silver_conditions", "clinical_category", ("disorder", "finding", "situation", "unknown")),
    _accepted("silver_conditions", "condition_flag", ("diabetes_t2", "hypertension", "heart_failure", "copd"), True),
    *_model("silver_medications", "medication_request_id", ("medication_display",)),
    _accepted("silver_medications", "status", ("active", "completed")),
    _accepted(
        "silver_medications",
        "medication_flag",
        ("diabetes_drug", "antihypertensive", "heart_failure_drug", "copd_drug"),
        True,
    ),
    *_model(
        "silver_observations",
        "observation_id",
        ("observation_kind", "is_plausible_value", "is_critical_value"),
    ),
]


# Bounds of the published data set. They belong to one generated data set,
# so the suite takes them as parameters.
@dataclass(frozen=True)
class Bounds:
    row_counts: Mapping[str, int] = field(
        default_factory=lambda: {
            "silver_patients": 11446,
            "silver_encounters": 669189,
            "silver_conditions": 414851,
            "silver_medications": 574828,
            "silver_observations": 8348416,
        }
    )
    disorder_share: tuple[float, float] = (0.30, 0.36)
    finding_share: tuple[float, float] = (0.42, 0.48)
    unknown_share_below: float = 0.01
    diabetes_patients: tuple[int, int] = (1700, 1760)
    hypertension_patients: tuple[int, int] = (2600, 2730)
    heart_failure_patients: tuple[int, int] = (300, 340)
    implausible_hba1c_share: tuple[float, float] = (0.45, 0.55)
    diabetes_treatment_rate: tuple[float, float] = (0.62, 0.72)


# What `distribution_checks` reads of each model; a table that is written for the checks alone needs no other columns.
CHECKED_COLUMNS: dict[str, tuple[str, ...]] = {
    "silver_patients": ("patient_id",),
    "silver_encounters": ("encounter_id",),
    "silver_conditions": ("patient_id", "clinical_category", "condition_flag", "is_billable_diagnosis"),
    "silver_medications": ("patient_id", "medication_flag"),
    "silver_observations": ("observation_kind", "is_plausible_value"),
}


def _share(condition):
    return F.try_divide(F.count_if(condition).cast("double"), F.count(F.lit(1)))


_COHORTS = ("diabetes_t2", "hypertension", "heart_failure")


def _cohort_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A column per cohort, from one pass over the conditions."""
    return cohorts.cohort_sizes(tables["silver_conditions"], {c: F.col("condition_flag") == c for c in _COHORTS})


def _treatment_rate(tables: Mapping[str, DataFrame]) -> DataFrame:
    return cohorts.treatment_rate(
        tables["silver_conditions"],
        tables["silver_medications"],
        F.col("condition_flag") == "diabetes_t2",
        F.col("medication_flag") == "diabetes_drug",
    ).select("rate")


def distribution_checks(bounds: Bounds | None = None) -> list[Check]:
    b = bounds or Bounds()
    category = F.col("clinical_category")
    hba1c = F.col("observation_kind") == "hba1c"
    checks = [
        Check(f"{table} row count", F.count(F.lit(1)), table, n, n)
        for table, n in b.row_counts.items()
    ]
    checks += [
        Check("disorder share", _share(category == "disorder"), "silver_conditions", *b.disorder_share),
        Check("finding share", _share(category == "finding"), "silver_conditions", *b.finding_share),
        Check(
            "unknown category share",
            _share(category == "unknown"),
            "silver_conditions",
            high=b.unknown_share_below,
            high_open=True,
            notes="a rise means a display suffix without a mapping",
        ),
        Check(
            "billable flag agrees with disorder category",
            F.count_if(F.col("is_billable_diagnosis") != (category == "disorder")),
            "silver_conditions",
            0,
            0,
        ),
        Check("T2DM patients", _cohort_sizes, None, *b.diabetes_patients, column="diabetes_t2"),
        Check("hypertension patients", _cohort_sizes, None, *b.hypertension_patients, column="hypertension"),
        Check("heart failure patients", _cohort_sizes, None, *b.heart_failure_patients, column="heart_failure"),
        Check(
            "implausible HbA1c share",
            F.try_divide(
                F.count_if(hba1c & ~F.col("is_plausible_value")).cast("double"), F.count_if(hba1c)
            ),
            "silver_observations",
            *b.implausible_hba1c_share,
        ),
        Check("T2DM treatment rate", _treatment_rate, None, *b.diabetes_treatment_rate),
    ]
    return checks
