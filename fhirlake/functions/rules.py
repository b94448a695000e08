"""Rule sets of the silver models: plain data for the generic classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fhirlake.functions import classify as C

# --- Fixed values: clinical codes, words, labels and bounds. Order matters. ---

ENCOUNTER_TYPE = {
    "AMB": "ambulatory",
    "EMER": "emergency",
    "IMP": "inpatient",
    "HH": "home_health",
    "VR": "virtual",
}
ENCOUNTER_DEFAULT = "other"
INPATIENT_CLASS = "IMP"

CLINICAL_CATEGORY = [
    ("(disorder)", "disorder"),
    ("(finding)", "finding"),
    ("(situation)", "situation"),
    ("(procedure)", "procedure"),
    ("(event)", "event"),
    ("(morphologic abnormality)", "disorder"),
    ("(person)", "finding"),
]
CATEGORY_DEFAULT = "unknown"
BILLABLE_SUFFIXES = ["(disorder)", "(morphologic abnormality)"]

CONDITION_FLAG = [
    (
        [
            "44054006",
            "127013003",
            "90781000119102",
            "157141000119108",
            "368581000119106",
            "97331000119101",
            "60951000119105",
            "1551000119108",
            "1501000119109",
        ],
        "diabetes_t2",
    ),
    (["88805009", "84114007"], "heart_failure"),
    (["59621000"], "hypertension"),
    (["87433001"], "copd"),
]
STATUS_WHEN_MISSING = "active"
ACTIVE_CONDITION_STATUS = ["active", "recurrence", "relapse"]

MEDICATION_FLAG = [
    (["metformin", "insulin"], "diabetes_drug"),
    (["lisinopril", "amlodipine", "hydrochlorothiazide", "losartan"], "antihypertensive"),
    (["furosemide", "carvedilol"], "heart_failure_drug"),
    (["albuterol", "fluticasone"], "copd_drug"),
]
DRUG_CLASS = [
    (["metformin"], "biguanide"),
    (["insulin"], "insulin"),
    (["lisinopril"], "ace_inhibitor"),
    (["losartan"], "arb"),
    (["amlodipine"], "calcium_channel_blocker"),
    (["hydrochlorothiazide"], "thiazide_diuretic"),
    (["furosemide"], "loop_diuretic"),
    (["carvedilol"], "beta_blocker"),
    (["simvastatin", "atorvastatin"], "statin"),
    (["albuterol"], "bronchodilator"),
    (["fluticasone"], "inhaled_corticosteroid"),
    (["acetaminophen"], "analgesic"),
    (["ibuprofen"], "nsaid"),
    (["hydrocodone", "oxycodone", "fentanyl"], "opioid"),
]
DRUG_CLASS_DEFAULT = "other"
ACTIVE_MEDICATION_STATUS = "active"
TARGETED_DRUGS = [
    "metformin",
    "lisinopril",
    "furosemide",
    "albuterol",
    "losartan",
    "amlodipine",
    "carvedilol",
    "fluticasone",
    "hydrochlorothiazide",
]

HBA1C = "4548-4"
GLUCOSE = "2339-0"
SYSTOLIC = "8480-6"
DIASTOLIC = "8462-4"
HEART_RATE = "8867-4"
EGFR = "33914-3"

OBSERVATION_KIND = [
    ([HBA1C], "hba1c"),
    ([GLUCOSE], "glucose_blood"),
    ([SYSTOLIC, DIASTOLIC], "blood_pressure"),
    ([HEART_RATE], "heart_rate"),
    (["9279-1"], "respiratory_rate"),
    (["8302-2"], "height"),
    (["29463-7"], "weight"),
    (["39156-5"], "bmi"),
    ([EGFR], "egfr_kidney"),
    (["2160-0"], "creatinine"),
    (["2093-3", "2085-9", "2089-1", "13457-7"], "cholesterol_panel"),
    (["72166-2"], "smoking_status"),
    (["72514-3"], "pain_score"),
]
KIND_BY_CATEGORY = {
    "social-history": "social_history",
    "survey": "survey",
    "laboratory": "lab_other",
    "vital-signs": "vital_other",
}
KIND_DEFAULT = "other"

CRITICAL = [
    (HBA1C, ">=", 9),
    (GLUCOSE, ">=", 400),
    (GLUCOSE, "<=", 40),
    (SYSTOLIC, ">=", 180),
    (SYSTOLIC, "<=", 80),
    (DIASTOLIC, ">=", 120),
    (HEART_RATE, ">=", 130),
    (HEART_RATE, "<=", 40),
    (EGFR, "<", 30),
]
# Inclusive plausible range per code; other codes are always plausible.
PLAUSIBLE_RANGE = {
    HBA1C: (4, 15),
    SYSTOLIC: (60, 260),
    DIASTOLIC: (30, 150),
    HEART_RATE: (30, 220),
    GLUCOSE: (20, 800),
}

AGE_EDGES = [18, 40, 65]
AGE_LABELS = ["pediatric", "adult_young", "adult_middle", "senior"]

HBA1C_EDGES = [4, 5.7, 6.5, 9]
HBA1C_LABELS = [
    "< 4 (impossible)",
    "4.0-5.7 (normal)",
    "5.7-6.5 (prediabetic)",
    "6.5-9 (diabetic)",
    ">= 9 (severe diabetic)",
]

# --- Rules as columns ---


def encounter_type(class_code: Column) -> Column:
    return C.classify_map(class_code, ENCOUNTER_TYPE, ENCOUNTER_DEFAULT)


def is_inpatient(class_code: Column) -> Column:
    """NULL for a missing class, so that the not-null check reports it."""
    return class_code == INPATIENT_CLASS


def clinical_category(display: Column) -> Column:
    return C.classify_suffix(display, CLINICAL_CATEGORY, CATEGORY_DEFAULT)


def condition_flag(code: Column) -> Column:
    return C.classify_codes(code, CONDITION_FLAG, None)


def is_billable(display: Column) -> Column:
    """NULL for a missing display, so that the not-null check reports it."""
    return C.suffix_match(display, *BILLABLE_SUFFIXES)


def condition_active(abatement: Column, clinical_status: Column) -> Column:
    status = F.lower(F.coalesce(clinical_status, F.lit(STATUS_WHEN_MISSING)))
    return abatement.isNull() & C.code_in(status, ACTIVE_CONDITION_STATUS)


def medication_flag(display: Column) -> Column:
    return C.classify_contains(display, MEDICATION_FLAG, None)


def drug_class(display: Column) -> Column:
    return C.classify_contains(display, DRUG_CLASS, DRUG_CLASS_DEFAULT)


def medication_active(status: Column) -> Column:
    return F.lower(status) == ACTIVE_MEDICATION_STATUS


def observation_kind(loinc_code: Column, category: Column) -> Column:
    by_code = C.classify_codes(loinc_code, OBSERVATION_KIND, None)
    return F.coalesce(by_code, C.classify_map(category, KIND_BY_CATEGORY, KIND_DEFAULT))


def is_critical(loinc_code: Column, value: Column) -> Column:
    return C.flag_ranges(loinc_code, value, CRITICAL)


def is_plausible(loinc_code: Column, value: Column) -> Column:
    outside = [
        (code, comparison, bound)
        for code, (low, high) in PLAUSIBLE_RANGE.items()
        for comparison, bound in (("<", low), (">", high))
    ]
    return ~C.flag_ranges(loinc_code, value, outside)


def age_group(age_years: Column) -> Column:
    return C.band(age_years, AGE_EDGES, AGE_LABELS)


def hba1c_band(value: Column) -> Column:
    return C.band(value, HBA1C_EDGES, HBA1C_LABELS)
