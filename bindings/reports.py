"""The named analysis reports (Q)."""

from __future__ import annotations

from bindings import oracle
from bindings.relational import _RATE, _SHAPE_COUNTS, _SWEEP, _UNION
from bindings.registry import register
from fhirlake.operators import profile
from fhirlake.plans import analysis as q

RECORDS = ("patients", "encounters", "conditions", "medication_requests", "observations")


def _counts(relation: str, column: str, where: str = "true", patients: bool = False) -> str:
    extra = ", count(DISTINCT patient_id) AS patients" if patients else ""
    return f"SELECT {column}, count(*) AS n{extra} FROM {relation} WHERE {where} GROUP BY {column}"


def _top(relation: str, column: str, k: int, where: str = "true") -> str:
    return f"{_counts(relation, column, where)} ORDER BY n DESC, {column} NULLS LAST LIMIT {k}"


def _unique(relation: str, key: str) -> str:
    return f"SELECT count(*) AS n, count(DISTINCT {key}) AS unique_keys FROM {relation}"


def _summary(where: str, order: str) -> str:
    parts = {
        "patients": "count(DISTINCT patient_id) AS patients",
        "readings": "count(*) AS readings",
        "n": "count(*) AS n",
        "avg": "round(avg(value_numeric), {r}) AS avg_value",
        "min": "round(min(value_numeric), {r}) AS min_value",
        "max": "round(max(value_numeric), {r}) AS max_value",
    }
    return "SELECT " + ", ".join(parts[p] for p in order.split()) + f" FROM silver_observations WHERE {where}"


_T2DM = "patient_id IN (SELECT patient_id FROM silver_conditions WHERE condition_flag = 'diabetes_t2')"
_HTN = "SELECT patient_id FROM silver_conditions WHERE condition_flag = 'hypertension'"
_A1C = "observation_kind = 'hba1c'"

register("Q01_layer_counts", lambda d: q.layer_counts({f"bronze_{r}": d.bronze(r) for r in RECORDS}), _UNION)
register("Q02_top_conditions", lambda d: q.top_conditions(d.bronze("conditions")), _top("bronze_conditions", "display", 10))
register(
    "Q03_code_lookup",
    lambda d: q.code_lookup(d.bronze("conditions"), "59621000"),
    "SELECT display, code, code_system, count(*) AS n FROM bronze_conditions WHERE code = '59621000' GROUP BY ALL",
)
register("Q04a_encounter_keys", lambda d: profile.key_uniqueness(d.silver("encounters"), "encounter_id"), _unique("silver_encounters", "encounter_id"))
register("Q04b_encounter_types", lambda d: profile.distribution(d.silver("encounters"), "encounter_type"), _counts("silver_encounters", "encounter_type"))
register("Q04c_inpatient", lambda d: q.inpatient_count(d.silver("encounters")), "SELECT count(*) AS n FROM silver_encounters WHERE is_inpatient")
register("Q05a_condition_keys", lambda d: profile.key_uniqueness(d.silver("conditions"), "condition_id"), _unique("silver_conditions", "condition_id"))
register("Q05b_categories", lambda d: profile.distribution(d.silver("conditions"), "clinical_category"), _counts("silver_conditions", "clinical_category"))
register(
    "Q05c_condition_flags", lambda d: q.flag_distribution(d.silver("conditions"), "condition_flag"),
    _counts("silver_conditions", "condition_flag", "condition_flag IS NOT NULL", True),
)
register("Q05d_billable", lambda d: profile.distribution(d.silver("conditions"), "is_billable_diagnosis"), _counts("silver_conditions", "is_billable_diagnosis"))
register("Q06_unknown_displays", lambda d: q.unknown_displays(d.silver("conditions")), _top("silver_conditions", "display", 10, "clinical_category = 'unknown'"))
register("Q07a_top_drugs", lambda d: q.top_drugs(d.bronze("medication_requests")), _top("bronze_medication_requests", "medication_display", 20))
register(
    "Q07b_uncoded_drugs", lambda d: q.uncoded_drugs(d.bronze("medication_requests")),
    _top("bronze_medication_requests", "medication_display", 10, "code_system IS NULL"),
)
register("Q07c_targeted_drugs", lambda d: q.targeted_drugs(d.bronze("medication_requests")), _SWEEP)
register(
    "Q07d_sample",
    lambda d: profile.sample_rows(d.bronze("medication_requests"), 2, ["medication_request_id", "load_timestamp", "load_batch_id"]),
    "SELECT * FROM bronze_medication_requests ORDER BY medication_request_id, load_timestamp, load_batch_id LIMIT 2",
)
register("Q08a_medication_keys", lambda d: profile.key_uniqueness(d.silver("medications"), "medication_request_id"), _unique("silver_medications", "medication_request_id"))
register(
    "Q08b_medication_flags", lambda d: q.flag_distribution(d.silver("medications"), "medication_flag"),
    _counts("silver_medications", "medication_flag", "medication_flag IS NOT NULL", True),
)
register("Q08c_drug_classes", lambda d: profile.distribution(d.silver("medications"), "drug_class"), _counts("silver_medications", "drug_class"))
register(
    "Q08d_status_active", lambda d: profile.distribution(d.silver("medications"), "status", "is_active"),
    "SELECT status, is_active, count(*) AS n FROM silver_medications GROUP BY 1, 2",
)
for letter, pair in (("a", q.DIABETES), ("b", q.HYPERTENSION)):
    register(
        f"Q09{letter}_treated_{pair[0]}",
        lambda d, p=pair: q.treated_patients(d.silver("conditions"), d.silver("medications"), p),
        f"SELECT count(DISTINCT patient_id) AS patients FROM silver_conditions WHERE condition_flag = '{pair[0]}' "
        f"AND patient_id IN (SELECT patient_id FROM silver_medications WHERE medication_flag = '{pair[1]}')",
    )
register("Q10a_observation_keys", lambda d: profile.key_uniqueness(d.silver("observations"), "observation_id"), _unique("silver_observations", "observation_id"))
register(
    "Q10b_kinds", lambda d: profile.distribution(d.silver("observations"), "observation_kind", distinct="patient_id"),
    _counts("silver_observations", "observation_kind", patients=True),
)
register("Q10c_critical", lambda d: profile.distribution(d.silver("observations"), "is_critical_value"), _counts("silver_observations", "is_critical_value"))
register("Q10d_critical_by_kind", lambda d: q.critical_by_kind(d.silver("observations")), _counts("silver_observations", "observation_kind", "is_critical_value"))
register(
    "Q11_diabetics_with_hba1c", lambda d: q.diabetics_with_hba1c(d.silver("conditions"), d.silver("observations")),
    f"SELECT count(DISTINCT patient_id) AS patients FROM silver_observations WHERE {_A1C} AND {_T2DM}",
)
register(
    "Q12_hba1c_fanout", lambda d: q.hba1c_fanout(d.silver("conditions"), d.silver("observations")),
    "SELECT round(min(o.value_numeric), 2) AS min_value, round(avg(o.value_numeric), 2) AS avg_value, "
    "round(max(o.value_numeric), 2) AS max_value, count(*) AS readings FROM silver_conditions c "
    "JOIN silver_observations o ON o.patient_id = c.patient_id "
    "WHERE c.condition_flag = 'diabetes_t2' AND o.observation_kind = 'hba1c'",
)
register("Q13a_plausible", lambda d: profile.distribution(d.silver("observations"), "is_plausible_value"), _counts("silver_observations", "is_plausible_value"))
register("Q13b_implausible_by_kind", lambda d: q.implausible_by_kind(d.silver("observations")), _counts("silver_observations", "observation_kind", "NOT is_plausible_value"))
register("Q14_hba1c_plausible", lambda d: q.hba1c_summary(d.silver("observations")), _summary(f"{_A1C} AND is_plausible_value", "n min avg max").format(r=2))
register(
    "Q15_diabetic_hba1c_plausible",
    lambda d: q.diabetic_hba1c(d.silver("conditions"), d.silver("observations"), True).select("patients", "readings", "avg_value"),
    _summary(f"{_A1C} AND is_plausible_value AND {_T2DM}", "patients readings avg").format(r=2),
)
register(
    "Q16_hba1c_by_unit", lambda d: q.hba1c_by_unit(d.silver("observations")),
    _summary(_A1C, "n min avg max").format(r=2).replace("SELECT ", "SELECT unit, ", 1) + " GROUP BY unit",
)
register(
    "Q17_hba1c_bands", lambda d: q.hba1c_bands(d.silver("observations")),
    f"SELECT {oracle.band_sql('value_numeric')} AS a1c_band, count(*) AS n FROM silver_observations "
    f"WHERE {_A1C} AND value_numeric IS NOT NULL GROUP BY 1",
)
register(
    "Q18_diabetic_hba1c", lambda d: q.diabetic_hba1c(d.silver("conditions"), d.silver("observations"), False),
    _summary(f"{_A1C} AND {_T2DM}", "patients readings avg min max").format(r=2),
)
_SYSTOLIC = "loinc_code = '8480-6' AND is_plausible_value"
register(
    "Q19_htn_systolic", lambda d: q.systolic(d.silver("conditions"), d.silver("observations")),
    _summary(f"{_SYSTOLIC} AND patient_id IN ({_HTN})", "patients readings avg min max").format(r=1),
)
register(
    "Q20_control_systolic",
    lambda d: q.systolic(d.silver("conditions"), d.silver("observations"), control=True).select("patients", "readings", "avg_value"),
    _summary(f"{_SYSTOLIC} AND patient_id NOT IN ({_HTN})", "patients readings avg").format(r=1),
)
register("Q21a_value_types", lambda d: q.value_types(d.bronze("observations")), _SHAPE_COUNTS)
register(
    "Q21b_top_codes", lambda d: q.top_observation_codes(d.bronze("observations")),
    "SELECT loinc_code, loinc_display, count(*) AS n FROM bronze_observations GROUP BY 1, 2 "
    "ORDER BY n DESC, loinc_code NULLS LAST, loinc_display NULLS LAST LIMIT 15",
)
register(
    "Q21c_blood_pressure_pairs", lambda d: q.blood_pressure_counts(d.bronze("observations")),
    "SELECT loinc_code, loinc_display, count(*) AS n FROM bronze_observations WHERE loinc_code IN ('8480-6', '8462-4') GROUP BY 1, 2",
)
register(
    "Q22_category_shares", lambda d: q.category_shares(d.silver("conditions")),
    "SELECT " + ", ".join(
        f"round(count(*) FILTER (WHERE clinical_category = '{c}') * 1.0 / count(*), 6) AS {c}_share"
        for c in ("disorder", "finding", "unknown")
    ) + " FROM silver_conditions",
)
register(
    "Q23_chronic_cohorts", lambda d: q.chronic_cohorts(d.silver("conditions")),
    "SELECT " + ", ".join(
        f"count(DISTINCT patient_id) FILTER (WHERE condition_flag = '{c}') AS {c}"
        for c in ("diabetes_t2", "hypertension", "heart_failure")
    ) + " FROM silver_conditions",
)
register(
    "Q24_implausible_hba1c", lambda d: q.implausible_hba1c_share(d.silver("observations")),
    f"SELECT round(count(*) FILTER (WHERE NOT is_plausible_value) * 1.0 / count(*), 6) AS implausible_share "
    f"FROM silver_observations WHERE {_A1C}",
)
register(
    "Q25_diabetes_treatment_rate",
    lambda d: q.diabetes_treatment_rate(d.silver("conditions"), d.silver("medications")),
    _RATE.format(condition="diabetes_t2", drug="diabetes_drug"),
)
register(
    "Q26_unnamed_drug", lambda d: q.unnamed_drug(d.bronze("medication_requests")),
    "SELECT medication_request_id, patient_id FROM bronze_medication_requests WHERE medication_display IS NULL "
    "ORDER BY medication_request_id, patient_id LIMIT 1",
)
