"""Silver models: latest row per key, typed and classified. Each depends on bronze only."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fhirlake.functions import dates, rules
from fhirlake import schemas
from fhirlake.operators.dedupe import latest_by
from fhirlake.sources.catalog import materialize
from fhirlake.sources.shared import run_together

_AUDIT = ("load_timestamp", "load_batch_id")
# Settles equal load times; add columns where one batch may hold a key twice.
TIEBREAK = ("load_batch_id",)


def silver_patients(
    bronze: DataFrame, as_of: dt.date | str | None = None, tiebreak: Sequence[str] = TIEBREAK
) -> DataFrame:
    """``as_of`` fixes the day ages refer to; without it they refer to today."""
    today = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    latest = latest_by(bronze, "patient_id", tiebreak=tiebreak)
    age = dates.years_between(F.col("birth_date"), today)
    return latest.select(
        "patient_id",
        "given_name",
        "family_name",
        F.lower("gender").alias("gender"),
        "birth_date",
        "deceased_date",
        F.col("deceased_date").isNotNull().alias("is_deceased"),
        age.alias("age_years_current"),
        dates.years_between(F.col("birth_date"), F.col("deceased_date")).alias("age_at_death"),
        rules.age_group(age).alias("age_group"),
        "marital_status",
        "race",
        "ethnicity",
        "city",
        "state",
        "postal_code",
        "country",
        *_AUDIT,
    )


def silver_encounters(bronze: DataFrame, tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    start, end = F.col("start_time"), F.col("end_time")
    return latest_by(bronze, "encounter_id", tiebreak=tiebreak).select(
        "encounter_id",
        "patient_id",
        "provider_id",
        "status",
        "class_code",
        rules.encounter_type(F.col("class_code")).alias("encounter_type"),
        rules.is_inpatient(F.col("class_code")).alias("is_inpatient"),
        "type_code",
        "type_display",
        "reason_code",
        "reason_display",
        "start_time",
        "end_time",
        dates.minutes_between(start, end).alias("duration_minutes"),
        dates.days_between(start, end).alias("length_of_stay_days"),
        *_AUDIT,
    )


def silver_conditions(bronze: DataFrame, tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    display = F.col("display")
    return latest_by(bronze, "condition_id", tiebreak=tiebreak).select(
        "condition_id",
        "patient_id",
        "encounter_id",
        F.col("code").alias("snomed_code"),
        "display",
        rules.clinical_category(display).alias("clinical_category"),
        rules.condition_flag(F.col("code")).alias("condition_flag"),
        rules.is_billable(display).alias("is_billable_diagnosis"),
        "clinical_status",
        "verification_status",
        "onset_date",
        "abatement_date",
        "recorded_date",
        rules.condition_active(F.col("abatement_date"), F.col("clinical_status")).alias("is_active"),
        *_AUDIT,
    )


def silver_medications(bronze: DataFrame, tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    display = F.col("medication_display")
    return latest_by(bronze, "medication_request_id", tiebreak=tiebreak).select(
        "medication_request_id",
        "patient_id",
        "encounter_id",
        "status",
        "intent",
        "code_system",
        F.col("medication_code").alias("rxnorm_code"),
        "medication_display",
        rules.medication_flag(display).alias("medication_flag"),
        rules.medication_active(F.col("status")).alias("is_active"),
        rules.drug_class(display).alias("drug_class"),
        "authored_on",
        "dosage_text",
        *_AUDIT,
    )


def silver_observations(bronze: DataFrame, tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    code, value = F.col("loinc_code"), F.col("value_numeric")
    return latest_by(bronze, "observation_id", tiebreak=tiebreak).select(
        "observation_id",
        "parent_observation_id",
        "patient_id",
        "encounter_id",
        "status",
        "category",
        "loinc_code",
        "loinc_display",
        "value_numeric",
        "value_text",
        "value_code",
        "value_code_system",
        "unit",
        rules.observation_kind(code, F.col("category")).alias("observation_kind"),
        rules.is_critical(code, value).alias("is_critical_value"),
        rules.is_plausible(code, value).alias("is_plausible_value"),
        value.isNotNull().alias("is_numeric"),
        "effective_date",
        "issued_date",
        *_AUDIT,
    )


# Silver model -> bronze record it is built from, and its builder.
MODELS: dict[str, tuple[str, Callable[..., DataFrame]]] = {
    "silver_patients": ("patients", silver_patients),
    "silver_encounters": ("encounters", silver_encounters),
    "silver_conditions": ("conditions", silver_conditions),
    "silver_medications": ("medication_requests", silver_medications),
    "silver_observations": ("observations", silver_observations),
}


# Columns that reports filter the largest tables by.
SORTED = {"silver_observations": "loinc_code"}


def build_silver(
    bronze: Mapping[str, DataFrame],
    as_of: dt.date | str | None = None,
    tiebreak: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, DataFrame]:
    """All five models from the five bronze record sets.

    Which of several rows of a key in one batch survives is settled by ``tiebreak`` (columns per record set), by
    default the batch id and then all other columns, so that a repeated task gives the same row.
    """
    built = {}
    for name, (record, build) in MODELS.items():
        ties = (tiebreak or {}).get(record) or (*TIEBREAK, *schemas.RECORDS[record].names)
        extra = {"as_of": as_of} if record == "patients" else {}
        built[name] = build(bronze[record], **extra, tiebreak=ties)
    return built


def materialize_silver(
    bronze: Mapping[str, DataFrame],
    as_of: dt.date | str | None = None,
    layer: str = "silver",
    buckets: int | None = None,
    tiebreak: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, DataFrame]:
    """Rebuild all five silver tables; they do not depend on each other and run together.

    With ``buckets`` every table is bucketed by patient, the key of all later joins.
    """

    def build(name: str, df: DataFrame) -> DataFrame:
        return materialize(df, layer, name, "patient_id" if buckets else None, buckets, SORTED.get(name))

    models = build_silver(bronze, as_of, tiebreak)
    tables = run_together([partial(build, name, df) for name, df in models.items()])
    return dict(zip(models, tables))
