import pytest
from pyspark.sql import functions as F

from fhirlake.operators import quality
from fhirlake.operators.quality import Check, ColumnTest
from fhirlake.plans import contract


@pytest.fixture(scope="module")
def tables(spark):
    parent = spark.createDataFrame([("p1",), ("p2",)], "patient_id string")
    child = spark.createDataFrame(
        [("a", "p1", "x", True), ("a", "p1", "x", True), ("b", "p9", "bad", False), (None, None, None, None),
         (None, "p9", "x", True), ("c", "p2", "other", True)],
        "id string, patient_id string, kind string, flag boolean",
    )
    return {"parent": parent, "child": child, "empty": child.limit(0)}


def test_each_kind_of_test(tables):
    tests = [
        ColumnTest("child", "id", quality.UNIQUE),
        ColumnTest("child", "id", quality.NOT_NULL),
        ColumnTest("child", "kind", quality.ACCEPTED, ("x",)),
        ColumnTest("child", "kind", quality.ACCEPTED, ("x",), "flag"),
        ColumnTest("child", "patient_id", quality.FOREIGN_KEY, parent=("parent", "patient_id")),
        ColumnTest("parent", "patient_id", quality.UNIQUE),
    ]
    report = quality.column_test_report(tables, tests).collect()
    got = sorted((r.model, r.column_name, r.test, r.violations) for r in report)
    assert got == [
        ("child", "id", "not_null", 2),
        ("child", "id", "unique", 1),
        ("child", "kind", "accepted_values", 1),
        ("child", "kind", "accepted_values", 2),
        ("child", "patient_id", "relationships", 2),
        ("parent", "patient_id", "unique", 0),
    ]


def test_single_expectations(tables):
    child, parent = tables["child"], tables["parent"]
    assert quality.expect_unique(child, "id").first().violations == 1
    assert quality.expect_not_null(child, "id").first().violations == 2
    assert quality.expect_in(child, "kind", ["x"], "kind = 'other'").first().violations == 1
    assert quality.expect_fk(child, parent, "patient_id").first().violations == 2
    assert quality.expect_fk(parent, parent, "patient_id").first().violations == 0
    assert quality.expect_agree(child, F.col("flag"), F.col("kind") == "x").first().violations == 1
    assert quality.expect_count(child, 6).first().asDict() == {"n": 6, "expected": 6, "passed": True}
    assert quality.expect_count(child, 7).first().passed is False


def test_figures_of_one_function_are_computed_once(spark):
    conditions = spark.createDataFrame(
        [("a", "diabetes_t2"), ("a", "diabetes_t2"), ("b", "diabetes_t2"), ("b", "hypertension"), ("c", None)],
        "patient_id string, condition_flag string",
    )
    wanted = [c for c in contract.distribution_checks() if c.value is contract._cohort_sizes]
    report = quality.suite_report({"silver_conditions": conditions}, wanted)
    assert {r.check_name: r.value for r in report.collect()} == {"T2DM patients": 2, "hypertension patients": 1, "heart failure patients": 0}
    assert report._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + report._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1
    run = {r.check_name: (r.value, r.error) for r in quality.run_suite(spark, {"silver_conditions": conditions}, wanted).collect()}
    assert run["hypertension patients"] == (1, None)


def test_orphan_rows_are_counted_per_key_before_the_join(tables):
    plan = quality.orphan_keys(tables["child"], tables["parent"], "patient_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftAnti") < plan.index("Aggregate [patient_id")


def checks():
    share = F.try_divide(F.count_if("flag").cast("double"), F.count(F.lit(1)))
    return [
        Check("rows", F.count(F.lit(1)), "child", 6, 6),
        Check("share", share, "child", 0.5, 0.7, notes="n"),
        Check("below", share, "child", high=0.6666, high_open=True),
        Check("above", share, "child", low=0.9),
        Check("nothing", share, "empty", 0, 1),
        Check("joined", lambda t: t["child"].join(t["parent"], "patient_id").agg(F.count(F.lit(1))), None, 3, 3),
    ]


def test_suite_report(tables):
    report = {r.check_name: r for r in quality.suite_report(tables, checks()).collect()}
    assert {n: r.passed for n, r in report.items()} == {
        "rows": True, "share": True, "below": False, "above": False, "nothing": False, "joined": True,
    }
    assert report["rows"].expected == "== 6" and report["share"].expected == "0.5 .. 0.7"
    assert report["below"].expected == "< 0.6666" and report["above"].expected == ">= 0.9"
    assert report["nothing"].value is None and report["share"].notes == "n"


def test_broken_checks_fail_alone(spark, tables):
    broken = [
        Check("no column", F.max("nope"), "child", 0, 1),
        Check("no table", F.count(F.lit(1)), "missing", 0, 1),
        Check("no join", lambda t: t["gone"].agg(F.count(F.lit(1))), None, 0, 1),
        Check("run time", F.max(F.raise_error(F.lit("boom"))), "parent", 0, 1),
    ]
    report = quality.run_suite(spark, tables, checks() + broken)
    rows = {r.check_name: r for r in report.collect()}
    assert len(rows) == 10 and rows["rows"].passed
    for check in broken:
        assert not rows[check.name].passed and rows[check.name].error
    with pytest.raises(quality.SuiteFailed, match="no column"):
        quality.assert_suite(report)
    quality.assert_suite(quality.run_suite(spark, tables, checks()[:2]))


def test_checks_on_one_table_share_one_scan(tables):
    plan = quality.suite_report(tables, checks()[:4])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_contract_size():
    counts = {}
    for test in contract.COLUMN_TESTS:
        counts[test.model] = counts.get(test.model, 0) + 1
    assert counts == {
        "silver_patients": 5, "silver_encounters": 6, "silver_conditions": 8, "silver_medications": 7, "silver_observations": 7,
    }


def test_suite_size(spark):
    assert len(contract.distribution_checks()) == 14


def test_tables_for_tests_and_checks_hold_what_is_read_alone(spark):
    from bindings import models, shapes
    from bindings.registry import Data

    tests = [quality.ColumnTest("a", "x", quality.NOT_NULL), quality.ColumnTest("a", "x", quality.FOREIGN_KEY, parent=("b", "y"))]
    assert quality.tested_columns(tests) == {"a": ["x"], "b": ["y"]}
    d = Data(spark, "/root/testdata/sf0.001")
    written = models._tables(d), models._suite_tables(d)
    for tables, read in zip(written, (quality.tested_columns(contract.COLUMN_TESTS), contract.CHECKED_COLUMNS)):
        assert {name: df.columns for name, df in tables.items()} == {name: list(read[name]) for name in tables}
        assert len(tables) == len(shapes.SHAPES)
