"""DuckDB relations the oracle statements are written on.

`statement(body)` prefixes a body with exactly the relations it names, so each registered
statement stands alone. Rules are applied by looking the rule list up in order, not by the
CASE chains Spark runs, so that the two sides are different formulations.
"""

from __future__ import annotations

import re

from bindings import shapes
from fhirlake.functions import rules


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def first_rule(pairs: list[tuple[str, str]], test: str) -> str:
    """Label of the first (pattern, label) pair whose pattern passes ``test`` on ``r.p``."""
    rows = ", ".join(f"{{'p': {_quoted(p)}, 'l': {_quoted(label)}}}" for p, label in pairs)
    return f"list_filter([{rows}], lambda r: {test})[1].l"


def _flat(sets: list[tuple[list[str], str]]) -> list[tuple[str, str]]:
    return [(pattern, label) for patterns, label in sets for pattern in patterns]


def category_sql(display: str = "display") -> str:
    return f"coalesce({first_rule(rules.CLINICAL_CATEGORY, f'ends_with(lower({display}), r.p)')}, 'unknown')"


def condition_flag_sql(code: str = "code") -> str:
    return first_rule(_flat(rules.CONDITION_FLAG), f"r.p = {code}")


def medication_flag_sql(display: str = "medication_display") -> str:
    return first_rule(_flat(rules.MEDICATION_FLAG), f"contains(lower({display}), r.p)")


def drug_class_sql(display: str = "medication_display") -> str:
    return f"coalesce({first_rule(_flat(rules.DRUG_CLASS), f'contains(lower({display}), r.p)')}, 'other')"


def encounter_type_sql(code: str = "class_code") -> str:
    return f"coalesce({first_rule(list(rules.ENCOUNTER_TYPE.items()), f'r.p = {code}')}, 'other')"


def kind_sql(code: str = "loinc_code", category: str = "category") -> str:
    by_code = first_rule(_flat(rules.OBSERVATION_KIND), f"r.p = {code}")
    by_category = first_rule(list(rules.KIND_BY_CATEGORY.items()), f"r.p = {category}")
    return f"coalesce({by_code}, {by_category}, 'other')"


def critical_sql(code: str = "loinc_code", value: str = "value_numeric") -> str:
    tests = " OR ".join(f"({code} = '{c}' AND {value} {op} {b})" for c, op, b in rules.CRITICAL)
    return f"coalesce({tests}, false)"


def plausible_sql(code: str = "loinc_code", value: str = "value_numeric") -> str:
    tests = " AND ".join(
        f"({code} IS DISTINCT FROM '{c}' OR coalesce({value} BETWEEN {low} AND {high}, true))"
        for c, (low, high) in rules.PLAUSIBLE_RANGE.items()
    )
    return f"({tests})"


def billable_sql(display: str = "display") -> str:
    tests = " OR ".join(f"ends_with(lower({display}), '{s}')" for s in rules.BILLABLE_SUFFIXES)
    return f"({tests})"


def active_sql() -> str:
    return "(abatement_date IS NULL AND lower(coalesce(clinical_status, 'active')) IN ('active', 'recurrence', 'relapse'))"


def age_group_sql(age: str) -> str:
    return (
        f"CASE WHEN {age} >= 65 OR {age} IS NULL THEN 'senior' WHEN {age} >= 40 THEN 'adult_middle' "
        f"WHEN {age} >= 18 THEN 'adult_young' ELSE 'pediatric' END"
    )


def band_sql(value: str) -> str:
    labels = rules.HBA1C_LABELS
    return (
        f"CASE WHEN {value} >= 9 OR {value} IS NULL THEN '{labels[4]}' WHEN {value} >= 6.5 THEN '{labels[3]}' "
        f"WHEN {value} >= 5.7 THEN '{labels[2]}' WHEN {value} >= 4 THEN '{labels[1]}' ELSE '{labels[0]}' END"
    )


def latest_sql(relation: str, key: str) -> str:
    return (
        f"SELECT * FROM {relation} QUALIFY row_number() OVER "
        f"(PARTITION BY {key} ORDER BY load_timestamp DESC, load_batch_id DESC) = 1"
    )


_AGE = f"date_diff('year', birth_date, date '{shapes.AS_OF}')"

RELATIONS: dict[str, str] = {f"bronze_{r}": shapes.bronze_sql(r) for r in shapes.SHAPES}
RELATIONS |= {
    "silver_patients": f"""SELECT patient_id, given_name, family_name, lower(gender) AS gender, birth_date,
  deceased_date, deceased_date IS NOT NULL AS is_deceased, {_AGE} AS age_years_current,
  date_diff('year', birth_date, cast(deceased_date AS date)) AS age_at_death,
  {age_group_sql(_AGE)} AS age_group, marital_status, race, ethnicity, city, state, postal_code, country,
  load_timestamp, load_batch_id
FROM ({latest_sql("bronze_patients", "patient_id")})""",
    "silver_encounters": f"""SELECT encounter_id, patient_id, provider_id, status, class_code,
  {encounter_type_sql()} AS encounter_type, class_code = 'IMP' AS is_inpatient, type_code, type_display,
  reason_code, reason_display, start_time, end_time,
  date_diff('minute', start_time, end_time) AS duration_minutes,
  date_diff('day', cast(start_time AS date), cast(end_time AS date)) AS length_of_stay_days,
  load_timestamp, load_batch_id
FROM ({latest_sql("bronze_encounters", "encounter_id")})""",
    "silver_conditions": f"""SELECT condition_id, patient_id, encounter_id, code AS snomed_code, display,
  {category_sql()} AS clinical_category, {condition_flag_sql()} AS condition_flag,
  {billable_sql()} AS is_billable_diagnosis, clinical_status, verification_status, onset_date,
  abatement_date, recorded_date, {active_sql()} AS is_active, load_timestamp, load_batch_id
FROM ({latest_sql("bronze_conditions", "condition_id")})""",
    "silver_medications": f"""SELECT medication_request_id, patient_id, encounter_id, status, intent, code_system,
  medication_code AS rxnorm_code, medication_display, {medication_flag_sql()} AS medication_flag,
  lower(status) = 'active' AS is_active, {drug_class_sql()} AS drug_class, authored_on, dosage_text,
  load_timestamp, load_batch_id
FROM ({latest_sql("bronze_medication_requests", "medication_request_id")})""",
    "silver_observations": f"""SELECT observation_id, parent_observation_id, patient_id, encounter_id, status, category,
  loinc_code, loinc_display, value_numeric, value_text, value_code, value_code_system, unit,
  {kind_sql()} AS observation_kind, {critical_sql()} AS is_critical_value,
  {plausible_sql()} AS is_plausible_value, value_numeric IS NOT NULL AS is_numeric,
  effective_date, issued_date, load_timestamp, load_batch_id
FROM ({latest_sql("bronze_observations", "observation_id")})""",
    # Parents with every tenth patient left out, so that foreign-key checks find orphans.
    "some_patients": "SELECT * FROM silver_patients WHERE cast(substr(patient_id, 2) AS bigint) % 10 <> 0",
}


def _needed(text: str, seen: dict[str, None]) -> None:
    for name, sql in RELATIONS.items():
        if name not in seen and re.search(rf"\b{name}\b", text):
            _needed(sql, seen)
            seen[name] = None


def statement(body: str) -> str:
    seen: dict[str, None] = {}
    _needed(body, seen)
    if not seen:
        return body
    relations = ",\n".join(f"{name} AS ({RELATIONS[name]})" for name in seen)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {relations},\n{body.lstrip()[5:]}"
    return f"WITH {relations}\n{body}"
