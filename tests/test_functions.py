import datetime as dt

import pytest
from pyspark.sql import functions as F

from fhirlake.functions import classify, dates, paths, rules


def one(spark, column, **values):
    """Evaluate a column over one row of literals."""
    types = {str: "string", int: "long", float: "double", bool: "boolean"}
    cols = [
        F.lit(v).cast(types.get(type(v), "string")).alias(k) if v is not None else F.lit(None).cast("string").alias(k)
        for k, v in values.items()
    ]
    return spark.range(1).select(*cols).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("ref", "expected"),
    [
        (None, None),
        ("", None),
        ("urn:uuid:abc", "abc"),
        ("Patient/abc", "abc"),
        ("Organization?identifier=https://x/ids|abc", "abc"),
        ("Organization?identifier=a|b|abc", "abc"),
        ("Org?identifier=abc", "abc"),
        ("Org?identifier=a=abc", "abc"),
        ("abc", "abc"),
        ("http://h/Patient/x", "/h/Patient/x"),
        ("urn:uuid:", ""),
    ],
)
def test_normalize_ref(spark, ref, expected):
    assert one(spark, paths.normalize_ref(F.col("r")), r=ref) == expected


EXT = "array<struct<url:string,extension:array<struct<url:string,valueCoding:struct<display:string>>>>>"


@pytest.mark.parametrize(
    ("doc", "expected"),
    [
        ("null", None),
        ("[]", None),
        ('[{"url":"h/us-core-race","extension":[{"url":"text"}]},'
         '{"url":"h/us-core-race","extension":[{"url":"ombCategory","valueCoding":{"display":"B"}}]}]', "B"),
        ('[{"url":"h/us-core-race","extension":[{"url":"ombCategory"}]},'
         '{"url":"h/us-core-race","extension":[{"url":"ombCategory","valueCoding":{"display":"B"}}]}]', None),
        ('[{"url":"h/us-core-race"},{"url":"h/us-core-race-x"},'
         '{"url":"us-core-race","extension":[{"url":"ombCategory","valueCoding":{"display":"C"}}]}]', "C"),
        ('[{"extension":[{"url":"ombCategory","valueCoding":{"display":"no url"}}]}]', None),
    ],
)
def test_us_core_display(spark, doc, expected):
    parsed = F.from_json(F.concat(F.lit('{"e":'), F.col("d"), F.lit("}")), f"e {EXT}").getField("e")
    assert one(spark, paths.us_core_display(parsed, "us-core-race"), d=doc) == expected


def test_get_path_is_null_safe(spark):
    doc = F.from_json(F.col("d"), "a array<struct<b:string>>")
    assert one(spark, paths.get_path(doc, "a", 0, "b"), d='{"a":[{"b":"x"}]}') == "x"
    assert one(spark, paths.get_path(doc, "a", 3, "b"), d='{"a":[{"b":"x"}]}') is None
    assert one(spark, paths.get_path(doc, "a", -1, "b"), d='{"a":[{"b":"x"}]}') is None
    assert one(spark, paths.get_path(doc, "a", 0, "b"), d="{}") is None


@pytest.mark.parametrize(
    ("start", "end", "years", "minutes", "days"),
    [
        ("2000-12-31 23:59:59", "2001-01-01 00:00:00", 1, 1, 1),
        ("2024-01-01 00:00:59", "2024-01-01 00:01:00", 0, 1, 0),
        ("2024-01-01 00:01:00", "2024-01-01 00:01:59", 0, 0, 0),
        ("2024-03-01 00:00:00", "2024-02-29 23:59:00", 0, -1, -1),
    ],
)
def test_differences_count_boundaries(spark, start, end, years, minutes, days):
    a, b = F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz")
    assert one(spark, dates.years_between(a, b), a=start, b=end) == years
    assert one(spark, dates.minutes_between(a, b), a=start, b=end) == minutes
    assert one(spark, dates.days_between(a, b), a=start, b=end) == days


@pytest.mark.parametrize(
    ("text", "full"),
    [("2012", False), ("2012-05", False), ("2012-05-01", True), ("2012-5-1", True), (" 2012-05-01T10:00:00Z", True),
     ("12:30:00-05:00", False), ("nonsense", False)],
)
def test_full_date(spark, text, full):
    assert one(spark, dates.has_full_date(F.col("t")), t=text) is full


@pytest.mark.parametrize(
    ("display", "category", "billable"),
    [
        ("Gingivitis (disorder)", "disorder", True),
        ("Stress (FINDING)", "finding", False),
        ("Review (situation)", "situation", False),
        ("Dressing (procedure)", "procedure", False),
        ("Fall (event)", "event", False),
        ("Sprain (Morphologic Abnormality)", "disorder", True),
        ("Refugee (person)", "finding", False),
        ("Gingivitis (disorder) ", "unknown", False),
        ("(disorder) first", "unknown", False),
        (None, "unknown", None),
    ],
)
def test_condition_display_rules(spark, display, category, billable):
    assert one(spark, rules.clinical_category(F.col("d").cast("string")), d=display) == category
    assert one(spark, rules.is_billable(F.col("d").cast("string")), d=display) is billable


@pytest.mark.parametrize(
    ("code", "flag"),
    [
        ("44054006", "diabetes_t2"), ("127013003", "diabetes_t2"), ("90781000119102", "diabetes_t2"),
        ("157141000119108", "diabetes_t2"), ("368581000119106", "diabetes_t2"), ("97331000119101", "diabetes_t2"),
        ("60951000119105", "diabetes_t2"), ("1551000119108", "diabetes_t2"), ("1501000119109", "diabetes_t2"),
        ("88805009", "heart_failure"), ("84114007", "heart_failure"), ("59621000", "hypertension"),
        ("87433001", "copd"), ("1", None), (None, None),
    ],
)
def test_condition_flag(spark, code, flag):
    assert one(spark, rules.condition_flag(F.col("c")), c=code) == flag


@pytest.mark.parametrize(
    ("abatement", "status", "active"),
    [(None, None, True), (None, "Recurrence", True), (None, "relapse", True), (None, "resolved", False), ("2024-01-01", "active", False)],
)
def test_condition_active(spark, abatement, status, active):
    column = rules.condition_active(F.col("a").cast("timestamp_ntz"), F.col("s").cast("string"))
    assert one(spark, column, a=abatement, s=status) is active


@pytest.mark.parametrize(
    ("drug", "flag", "drug_class"),
    [
        ("metFORMIN 500", "diabetes_drug", "biguanide"),
        ("Insulin Lispro", "diabetes_drug", "insulin"),
        ("lisinopril", "antihypertensive", "ace_inhibitor"),
        ("losartan", "antihypertensive", "arb"),
        ("amlodipine", "antihypertensive", "calcium_channel_blocker"),
        ("hydrochlorothiazide", "antihypertensive", "thiazide_diuretic"),
        ("hydrochlorothiazide 12.5 MG / lisinopril", "antihypertensive", "ace_inhibitor"),
        ("furosemide", "heart_failure_drug", "loop_diuretic"),
        ("carvedilol", "heart_failure_drug", "beta_blocker"),
        ("simvastatin", None, "statin"),
        ("simvastatin / metformin", "diabetes_drug", "biguanide"),
        ("atorvastatin", None, "statin"),
        ("albuterol", "copd_drug", "bronchodilator"),
        ("fluticasone", "copd_drug", "inhaled_corticosteroid"),
        ("acetaminophen / hydrocodone", None, "analgesic"),
        ("ibuprofen", None, "nsaid"),
        ("oxycodone", None, "opioid"),
        ("fentanyl", None, "opioid"),
        ("amoxicillin", None, "other"),
        (None, None, "other"),
    ],
)
def test_medication_rules(spark, drug, flag, drug_class):
    assert one(spark, rules.medication_flag(F.col("m").cast("string")), m=drug) == flag
    assert one(spark, rules.drug_class(F.col("m").cast("string")), m=drug) == drug_class


@pytest.mark.parametrize(
    ("code", "category", "kind"),
    [
        ("4548-4", None, "hba1c"), ("2339-0", None, "glucose_blood"), ("8480-6", "survey", "blood_pressure"),
        ("8462-4", None, "blood_pressure"), ("8867-4", None, "heart_rate"), ("9279-1", None, "respiratory_rate"),
        ("8302-2", None, "height"), ("29463-7", None, "weight"), ("39156-5", None, "bmi"), ("33914-3", None, "egfr_kidney"),
        ("2160-0", None, "creatinine"), ("2093-3", None, "cholesterol_panel"), ("2085-9", None, "cholesterol_panel"),
        ("2089-1", None, "cholesterol_panel"), ("13457-7", None, "cholesterol_panel"), ("72166-2", "social-history", "smoking_status"),
        ("72514-3", None, "pain_score"), ("x", "social-history", "social_history"), (None, "survey", "survey"),
        ("x", "laboratory", "lab_other"), ("x", "vital-signs", "vital_other"), ("x", "exam", "other"), (None, None, "other"),
    ],
)
def test_observation_kind(spark, code, category, kind):
    column = rules.observation_kind(F.col("c").cast("string"), F.col("g").cast("string"))
    assert one(spark, column, c=code, g=category) == kind


# (code, value, critical, plausible), at and beside every bound.
VALUES = [
    ("4548-4", 8.99, False, True), ("4548-4", 9.0, True, True), ("4548-4", 3.99, False, False), ("4548-4", 4.0, False, True),
    ("4548-4", 15.0, True, True), ("4548-4", 15.01, True, False),
    ("2339-0", 399.0, False, True), ("2339-0", 400.0, True, True), ("2339-0", 40.0, True, True), ("2339-0", 41.0, False, True),
    ("2339-0", 19.9, True, False), ("2339-0", 20.0, True, True), ("2339-0", 800.0, True, True), ("2339-0", 800.1, True, False),
    ("8480-6", 179.0, False, True), ("8480-6", 180.0, True, True), ("8480-6", 80.0, True, True), ("8480-6", 81.0, False, True),
    ("8480-6", 59.0, True, False), ("8480-6", 60.0, True, True), ("8480-6", 260.0, True, True), ("8480-6", 261.0, True, False),
    ("8462-4", 119.0, False, True), ("8462-4", 120.0, True, True), ("8462-4", 29.0, False, False), ("8462-4", 30.0, False, True),
    ("8462-4", 150.0, True, True), ("8462-4", 151.0, True, False),
    ("8867-4", 129.0, False, True), ("8867-4", 130.0, True, True), ("8867-4", 40.0, True, True), ("8867-4", 41.0, False, True),
    ("8867-4", 29.0, True, False), ("8867-4", 30.0, True, True), ("8867-4", 220.0, True, True), ("8867-4", 221.0, True, False),
    ("33914-3", 29.9, True, True), ("33914-3", 30.0, False, True), ("1-1", 9999.0, False, True), (None, 9.0, False, True),
    ("4548-4", None, False, True),
]


def test_value_rules(spark):
    df = spark.createDataFrame(VALUES, "c string, v double, critical boolean, plausible boolean")
    got = df.select(
        "*",
        rules.is_critical(F.col("c"), F.col("v")).alias("got_critical"),
        rules.is_plausible(F.col("c"), F.col("v")).alias("got_plausible"),
    )
    wrong = got.filter("NOT (critical <=> got_critical) OR NOT (plausible <=> got_plausible)")
    assert wrong.collect() == []


@pytest.mark.parametrize(
    ("value", "label"),
    [(3.9, "< 4 (impossible)"), (4.0, "4.0-5.7 (normal)"), (5.7, "5.7-6.5 (prediabetic)"), (6.5, "6.5-9 (diabetic)"), (9.0, ">= 9 (severe diabetic)")],
)
def test_hba1c_bands(spark, value, label):
    assert one(spark, rules.hba1c_band(F.col("v")), v=value) == label


def test_band_needs_matching_labels():
    with pytest.raises(ValueError):
        classify.band(None, [1, 2], ["a", "b"])


def test_encounter_type(spark):
    df = spark.createDataFrame(
        [("AMB",), ("EMER",), ("IMP",), ("HH",), ("VR",), ("XX",), (None,)], "c string"
    ).select("c", rules.encounter_type(F.col("c")).alias("t"), rules.is_inpatient(F.col("c")).alias("i"))
    assert [tuple(r) for r in df.collect()] == [
        ("AMB", "ambulatory", False), ("EMER", "emergency", False), ("IMP", "inpatient", True), ("HH", "home_health", False),
        ("VR", "virtual", False), ("XX", "other", False), (None, "other", None),
    ]


def test_age_group(spark):
    df = spark.createDataFrame([(17,), (18,), (39,), (40,), (64,), (65,), (None,)], "a int")
    groups = [r.g for r in df.select(rules.age_group(F.col("a")).alias("g")).collect()]
    assert groups == ["pediatric", "adult_young", "adult_young", "adult_middle", "adult_middle", "senior", "senior"]


def test_as_of_is_a_plain_date(spark):
    age = dates.years_between(F.lit("2000-12-31").cast("date"), F.lit(str(dt.date(2001, 1, 1))).cast("date"))
    assert spark.range(1).select(age.alias("a")).first().a == 1
