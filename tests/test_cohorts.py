"""Cohort figures against brute force, with one patient holding a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from fhirlake.operators import cohorts, profile

random.seed(7)
PEOPLE = [f"p{i}" for i in range(40)]
READINGS = [("p0" if i % 3 == 0 else random.choice(PEOPLE), None if i % 11 == 0 else float(i % 200)) for i in range(900)] + [(None, 5.0)]
CONDITIONS = [("p0", "a")] * 300 + [(random.choice(PEOPLE[:20]), random.choice("abc")) for _ in range(200)] + [(None, "a")]
DRUGS = [(random.choice(PEOPLE), random.choice("xy")) for _ in range(60)]


@pytest.fixture(scope="module")
def data(spark):
    return (
        spark.createDataFrame(READINGS, "patient_id string, v double").repartition(6),
        spark.createDataFrame(CONDITIONS, "patient_id string, flag string").repartition(6),
        spark.createDataFrame(DRUGS, "patient_id string, drug string"),
    )


def brute(values, patients):
    known = [v for v in values if v is not None]
    return {
        "patients": len(patients), "readings": len(values), "avg_value": round(sum(known) / len(known), 2),
        "min_value": min(known), "max_value": max(known),
    }


MEMBERS = {p for p, f in CONDITIONS if f == "a" and p}


def test_cohort_stats(data):
    readings, conditions, _ = data
    members = cohorts.cohort(conditions, F.col("flag") == "a")
    inside = [(p, v) for p, v in READINGS if p in MEMBERS]
    assert cohorts.cohort_stats(readings, "v", members).first().asDict() == brute([v for _, v in inside], {p for p, _ in inside})
    outside = [(p, v) for p, v in READINGS if p not in MEMBERS]
    got = cohorts.cohort_stats(readings, "v", members, control=True).first().asDict()
    assert got == brute([v for _, v in outside], {p for p, _ in outside if p})
    assert cohorts.in_cohort(readings, members).count() == len(inside)
    assert cohorts.not_in_cohort(readings, members).count() == len(outside)


def test_fanout_equals_the_plain_join(data):
    readings, conditions, _ = data
    flagged = conditions.filter("flag = 'a'")
    pairs = [(p, v) for q, f in CONDITIONS if f == "a" for p, v in READINGS if p == q and p]
    got = cohorts.fanout_stats(flagged, readings, "v").first().asDict()
    assert got == brute([v for _, v in pairs], {p for p, _ in pairs})
    once = cohorts.cohort_stats(readings, "v", cohorts.cohort(conditions, F.col("flag") == "a")).first()
    assert got["readings"] > once.readings and got["patients"] == once.patients


def test_fanout_never_builds_the_pairs(data):
    readings, conditions, _ = data
    plan = cohorts.fanout_stats(conditions, readings, "v")._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert plan.count("Aggregate [patient_id", join) == 2


def test_overlap_rate_sizes(data):
    _, conditions, drugs = data
    users = {p for p, d in DRUGS if d == "x"}
    overlap = cohorts.cohort_overlap(conditions.filter("flag = 'a'"), drugs.filter("drug = 'x'"))
    assert overlap.first().patients == len(MEMBERS & users)
    rate = cohorts.treatment_rate(conditions, drugs, F.col("flag") == "a", F.col("drug") == "x").first()
    # As in SQL, a missing patient id is one member of the DISTINCT cohort and never treated.
    assert (rate.patients, rate.treated_patients) == (len(MEMBERS) + 1, len(MEMBERS & users))
    assert rate.rate == pytest.approx(len(MEMBERS & users) / (len(MEMBERS) + 1))
    sizes = cohorts.cohort_sizes(conditions, {f: F.col("flag") == f for f in "abc"}).first().asDict()
    assert sizes == {f: len({p for p, g in CONDITIONS if g == f and p}) for f in "abc"}
    per = cohorts.rows_per_entity(conditions, F.col("flag") == "a").first()
    assert per.patients == len(MEMBERS) and per.rows == sum(1 for p, f in CONDITIONS if f == "a" and p)


def test_empty_inputs(spark, data):
    readings, conditions, drugs = data
    nobody = cohorts.cohort(conditions, F.col("flag") == "zzz")
    got = cohorts.cohort_stats(readings, "v", nobody).first()
    assert (got.patients, got.readings, got.avg_value) == (0, 0, None)
    rate = cohorts.treatment_rate(conditions, drugs, F.col("flag") == "zzz", F.col("drug") == "x").first()
    assert (rate.patients, rate.rate) == (0, None)
    assert profile.share(readings.limit(0), {"s": F.lit(True)}).first().s is None
    empty = spark.createDataFrame([], "value_numeric double, value_text string, value_code string, parent_observation_id string")
    assert profile.value_shape_counts(empty).first().asDict() == {
        "total": 0, "numeric_rows": None, "text_rows": None, "coded_rows": None, "component_rows": None,
    }


def test_joins_are_semi_and_anti(data):
    readings, conditions, _ = data
    members = cohorts.cohort(conditions, F.col("flag") == "a")
    for control, kind in ((False, "LeftSemi"), (True, "LeftAnti")):
        plan = cohorts.cohort_stats(readings, "v", members, control=control)._jdf.queryExecution().optimizedPlan().toString()
        # Readings are one row per patient before they meet the cohort.
        assert plan.index(f"Join {kind}") < plan.index("Aggregate [patient_id")
        assert "Cartesian" not in plan


def test_profiles(data, rows):
    readings, conditions, _ = data
    dist = profile.distribution(conditions, "flag", distinct="patient_id").collect()
    assert [r.n for r in dist] == sorted((r.n for r in dist), reverse=True)
    top = profile.top_k(conditions, "flag", 1)
    assert top.first().flag == "a"
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    summary = profile.numeric_summary(readings, "v").first()
    assert (summary.n, summary.min_value, summary.max_value) == (901, 0.0, 199.0)
    balance = profile.pair_balance(conditions, "flag", "b", "c").first()
    assert balance.first_rows == sum(f == "b" for _, f in CONDITIONS)
    assert profile.layer_row_counts({"z": readings, "a": conditions}).collect()[0].table_name == "a"
    words = {r.word: r.n for r in profile.count_matching(conditions, "flag", ["A", "q"]).collect()}
    assert words == {"A": sum(f == "a" for _, f in CONDITIONS), "q": 0}
