"""Silver models, rule sets and data-quality operators (M, R, D)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings import oracle
from bindings.registry import Data, register
from fhirlake.functions import rules
from fhirlake.operators import quality
from fhirlake.plans import contract
from fhirlake.sources.shared import run_together, through_table

for number, model in enumerate(["patients", "encounters", "conditions", "medications", "observations"], 1):
    register(f"M0{number}_{model}", lambda d, m=model: d.silver(m), f"SELECT * FROM silver_{model}")

# --- R: rule sets on bronze rows ---


def _rule(name: str, record: str, key: str, column, sql: str) -> None:
    register(
        name,
        lambda d: d.bronze(record).select(key, "load_batch_id", column().alias("label")),
        f"SELECT {key}, load_batch_id, {sql} AS label FROM bronze_{record}",
    )




def _code():
    return F.col("loinc_code")


def _value():
    return F.col("value_numeric")


def _drug():
    return F.col("medication_display")


_rule("R01_encounter_type", "encounters", "encounter_id", lambda: rules.encounter_type(F.col("class_code")), oracle.encounter_type_sql())
_rule("R01_is_inpatient", "encounters", "encounter_id", lambda: rules.is_inpatient(F.col("class_code")), "class_code = 'IMP'")
_rule("R02_clinical_category", "conditions", "condition_id", lambda: rules.clinical_category(F.col("display")), oracle.category_sql())
_rule("R03_condition_flag", "conditions", "condition_id", lambda: rules.condition_flag(F.col("code")), oracle.condition_flag_sql())
_rule("R04_is_billable", "conditions", "condition_id", lambda: rules.is_billable(F.col("display")), oracle.billable_sql())
_rule(
    "R05_condition_active", "conditions", "condition_id",
    lambda: rules.condition_active(F.col("abatement_date"), F.col("clinical_status")), oracle.active_sql(),
)
_rule("R06_medication_flag", "medication_requests", "medication_request_id", lambda: rules.medication_flag(_drug()), oracle.medication_flag_sql())
_rule("R07_drug_class", "medication_requests", "medication_request_id", lambda: rules.drug_class(_drug()), oracle.drug_class_sql())
_rule(
    "R08_medication_active", "medication_requests", "medication_request_id",
    lambda: rules.medication_active(F.col("status")), "lower(status) = 'active'",
)
_rule("R09_observation_kind", "observations", "observation_id", lambda: rules.observation_kind(_code(), F.col("category")), oracle.kind_sql())
_rule("R10_critical", "observations", "observation_id", lambda: rules.is_critical(_code(), _value()), oracle.critical_sql())
_rule("R11_plausible", "observations", "observation_id", lambda: rules.is_plausible(_code(), _value()), oracle.plausible_sql())
_rule("R12_hba1c_band", "observations", "observation_id", lambda: rules.hba1c_band(_value()), oracle.band_sql("value_numeric"))

# --- D: data quality ---

register(
    "D01_unique",
    lambda d: quality.duplicate_keys(d.bronze("conditions"), "condition_id"),
    "SELECT condition_id, count(*) AS n FROM bronze_conditions WHERE condition_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
)
register(
    "D02_not_null",
    lambda d: quality.expect_not_null(d.silver("conditions"), "snomed_code"),
    "SELECT count(*) FILTER (WHERE snomed_code IS NULL) AS violations FROM silver_conditions",
)
register(
    "D03_accepted_values",
    lambda d: quality.expect_in(
        d.silver("conditions"), "clinical_category", ["disorder", "finding", "situation", "unknown"], "is_active"
    ),
    "SELECT count(*) AS violations FROM silver_conditions WHERE is_active "
    "AND clinical_category NOT IN ('disorder', 'finding', 'situation', 'unknown')",
)
register(
    "D04_relationships",
    lambda d: quality.expect_fk(d.silver("encounters"), d.some_patients(), "patient_id"),
    "SELECT count(*) AS violations FROM silver_encounters WHERE patient_id NOT IN (SELECT patient_id FROM some_patients)",
)
register(
    "D06_lockstep",
    lambda d: quality.expect_agree(
        d.silver("conditions"), F.col("is_billable_diagnosis"), F.col("is_active")
    ),
    "SELECT count(*) AS violations FROM silver_conditions WHERE is_billable_diagnosis <> is_active",
)
register(
    "D08_row_count",
    lambda d: quality.expect_count(d.silver("patients"), 1500),
    "SELECT count(*) AS n, cast(1500 AS bigint) AS expected, count(*) = 1500 AS passed FROM silver_patients",
)

_MODELS = ("patients", "encounters", "conditions", "medications", "observations")


def _written(tables: Mapping[str, DataFrame], read: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """The tables with the columns that are read of them; they do not depend on each other and are written together."""
    jobs = [partial(through_table, df.select(*read[name]), name) for name, df in tables.items()]
    return dict(zip(tables, run_together(jobs)))


def _tables(d: Data):
    """Silver written once, with the tested columns: every test then reads a table instead of deriving the model anew."""
    tables = {f"silver_{m}": d.some_patients() if m == "patients" else d.silver(m) for m in _MODELS}
    return _written(tables, quality.tested_columns(contract.COLUMN_TESTS))


_RENAMED = {"silver_patients": "some_patients"}


def _test_sql(test: quality.ColumnTest) -> str:
    relation = _RENAMED.get(test.model, test.model)
    column = test.column
    if test.kind == quality.UNIQUE:
        count = f"(SELECT count(*) FROM (SELECT {column} FROM {relation} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1))"
    elif test.kind == quality.NOT_NULL:
        count = f"(SELECT count(*) FROM {relation} WHERE {column} IS NULL)"
    elif test.kind == quality.ACCEPTED:
        values = ", ".join(f"'{v}'" for v in test.values)
        count = f"(SELECT count(*) FROM {relation} WHERE {column} NOT IN ({values}))"
    else:
        count = f"(SELECT count(*) FROM {relation} WHERE {column} NOT IN (SELECT patient_id FROM some_patients))"
    return f"SELECT '{test.model}' AS model, '{column}' AS column_name, '{test.kind}' AS test, {count} AS violations"


register(
    "D01_D04_column_tests",
    lambda d: quality.column_test_report(_tables(d), contract.COLUMN_TESTS),
    " UNION ALL ".join(_test_sql(t) for t in contract.COLUMN_TESTS),
)

_BOUNDS = contract.Bounds(row_counts={f"silver_{m}": 1500 for m in _MODELS}, unknown_share_below=0.5)


def _figure_sql(name: str, figure: str, low, high, open_end: bool = False, notes: str = "") -> str:
    expected = f"== {low}" if low == high and low is not None else f"< {high}" if open_end else f"{low} .. {high}"
    inside = f"v < {high}" if open_end else f"v BETWEEN {low} AND {high}"
    return (
        f"SELECT '{name}' AS check_name, round(v, 6) AS value, '{expected}' AS expected, coalesce({inside}, false) AS passed, "
        f"'{notes}' AS notes, cast(NULL AS varchar) AS error FROM (SELECT cast({figure} AS double) AS v)"
    )


def _category_share_sql(category: str) -> str:
    return f"(SELECT avg(CASE WHEN clinical_category = '{category}' THEN 1.0 ELSE 0.0 END) FROM silver_conditions)"


def _patients_sql(flag: str) -> str:
    return f"(SELECT count(DISTINCT patient_id) FROM silver_conditions WHERE condition_flag = '{flag}')"


_CHECKS_SQL = [
    _figure_sql(f"silver_{m} row count", f"(SELECT count(*) FROM silver_{m})", 1500, 1500) for m in _MODELS
] + [
    _figure_sql("disorder share", _category_share_sql("disorder"), *_BOUNDS.disorder_share),
    _figure_sql("finding share", _category_share_sql("finding"), *_BOUNDS.finding_share),
    _figure_sql(
        "unknown category share", _category_share_sql("unknown"), None, 0.5, True,
        "a rise means a display suffix without a mapping",
    ),
    _figure_sql(
        "billable flag agrees with disorder category",
        "(SELECT count(*) FROM silver_conditions WHERE is_billable_diagnosis <> (clinical_category = 'disorder'))", 0, 0,
    ),
    _figure_sql("T2DM patients", _patients_sql("diabetes_t2"), *_BOUNDS.diabetes_patients),
    _figure_sql("hypertension patients", _patients_sql("hypertension"), *_BOUNDS.hypertension_patients),
    _figure_sql("heart failure patients", _patients_sql("heart_failure"), *_BOUNDS.heart_failure_patients),
    _figure_sql(
        "implausible HbA1c share",
        "(SELECT avg(CASE WHEN is_plausible_value THEN 0.0 ELSE 1.0 END) FROM silver_observations WHERE observation_kind = 'hba1c')",
        *_BOUNDS.implausible_hba1c_share,
    ),
    _figure_sql(
        "T2DM treatment rate",
        "(SELECT avg(CASE WHEN patient_id IN (SELECT patient_id FROM silver_medications WHERE medication_flag = 'diabetes_drug') "
        "THEN 1.0 ELSE 0.0 END) FROM (SELECT DISTINCT patient_id FROM silver_conditions WHERE condition_flag = 'diabetes_t2'))",
        *_BOUNDS.diabetes_treatment_rate,
    ),
]


def _suite_tables(d: Data):
    return _written({f"silver_{m}": d.silver(m) for m in _MODELS}, contract.CHECKED_COLUMNS)


register(
    "D05_range_checks",
    lambda d: quality.suite_report(_suite_tables(d), contract.distribution_checks(_BOUNDS)).withColumn(
        "value", F.round("value", 6)
    ),
    " UNION ALL ".join(_CHECKS_SQL),
)
register(
    "D07_suite_run",
    lambda d: quality.run_suite(d.spark, _suite_tables(d), contract.distribution_checks(_BOUNDS)).withColumn(
        "value", F.round("value", 6)
    ),
    " UNION ALL ".join(_CHECKS_SQL),
)
