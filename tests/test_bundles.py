import json

import pytest
from pyspark.sql import functions as F

from fhirlake import schemas
from fhirlake.operators import flatten, inspect, profile
from fhirlake.sources import bundles, parsed


def entry(resource_type, **fields):
    return {"fullUrl": f"urn:uuid:{fields.get('id')}", "resource": {"resourceType": resource_type, **fields}}


def coding(code=None, display=None, system=None):
    return {"coding": [{k: v for k, v in dict(system=system, code=code, display=display).items() if v is not None}]}


PATIENT = entry(
    "Patient", id="p1", gender="male", birthDate="1980-02-03",
    name=[{"given": ["Ann", "B"], "family": "First"}, {"given": ["X"], "family": "Second"}],
    maritalStatus=coding("M"), address=[{"city": "Boston", "state": "MA", "postalCode": "02101", "country": "US"}],
)
SUBJECT = {"subject": {"reference": "urn:uuid:p1"}, "encounter": {"reference": "Encounter/e1"}}
BP = [
    {"code": coding("8480-6", "Systolic"), "valueQuantity": {"value": 120, "unit": "mm[Hg]"}},
    {"code": coding("8462-4", "Diastolic"), "valueQuantity": {"value": 80.5, "unit": "mm[Hg]"}},
]
SURVEY = [
    {"code": coding("q1"), "valueCodeableConcept": {"text": "Said", **coding("LA1", "Shown", "l")}},
    {"code": coding("q2"), "valueCodeableConcept": coding("LA2", "Shown", "l")},
    {"code": coding("q3"), "valueString": "free"},
    {"code": coding("q4")},
]
FILES = {
    "Ann_1.json": [
        PATIENT,
        entry("Encounter", id="e1", status="finished", subject={"reference": "Patient/p1"}, type=[coding("t", "Type")],
              period={"start": "2020-01-01T10:00:00-05:00"}, serviceProvider={"reference": "Organization?identifier=https://x|o1"},
              **{"class": {"code": "AMB"}}),
        entry("Condition", id="c1", code=coding("59621000", "Hypertension (disorder)", "sct"), clinicalStatus=coding("active"),
              onsetDateTime="2020-01-01T10:00:00-05:00", **SUBJECT),
        entry("MedicationRequest", id="m1", status="active", intent="order", medicationCodeableConcept=coding("1", "Inline", "rx"),
              authoredOn="2020-01-01T10:00:00-05:00", **SUBJECT),
        entry("Observation", id="o1", status="final", code=coding("4548-4", "HbA1c"), valueQuantity={"value": 6.1, "unit": "%"},
              category=[coding("laboratory")], effectiveDateTime="2020-01-01T10:00:00-05:00", **SUBJECT),
    ],
    "Bob_2.json": [
        entry("MedicationRequest", id="m2", medicationReference={"reference": "urn:uuid:drug"}),
        entry("Medication", id="drug", code=coding("A", "First", "rx")),
        entry("Medication", id="drug", code=coding("B", "Last", "rx")),
        entry("MedicationRequest", id="m3", medicationCodeableConcept=coding(None, "Only text"), medicationReference={"reference": "Medication/drug"}),
        entry("MedicationRequest", id="m4", medicationCodeableConcept=coding("", "Only text"), medicationReference={"reference": "urn:uuid:gone"}),
        entry("MedicationRequest", id="m6", medicationCodeableConcept=coding("7", "Kept"), medicationReference={"reference": "urn:uuid:drug"}),
        entry("MedicationRequest", id="m7"),
        entry("Medication", id="", code=coding("Z")),
    ],
    "Cay_3.json": [entry("MedicationRequest", id="m5", medicationReference={"reference": "urn:uuid:drug"})],
    "Dan_4.json": [
        entry("Observation", id="bp", code=coding("85354-9"), component=BP),
        entry("Observation", id="sv", code=coding("93025-5"), component=SURVEY),
        entry("Observation", id="both", component=BP[:1], valueQuantity={"value": 1}),
        entry("Observation", id="hollow", valueQuantity={}),
        entry("Observation", id="null", valueQuantity=None),
        entry("Observation", id="bool", valueBoolean=True),
        entry("Observation", id="int", valueInteger=3, component=[]),
        entry("Observation", id="text", valueCodeableConcept={"text": "", **coding("LA9", "Shown")}),
        entry("Observation", id="note", valueString="narrative"),
        entry("Observation", component=BP[:1]),
        {"fullUrl": "no resource"},
        {"resource": {"id": "untyped"}},
    ],
    "Eve_5.json": [entry("Patient", id="p5", name=[{"given": [], "family": "F"}])],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("fhir")
    for name, entries in FILES.items():
        (path / name).write_text(json.dumps({"resourceType": "Bundle", "entry": entries}, indent=2), encoding="utf-8")
    (path / "bad_object.json").write_text("{bad")
    (path / "bad_list.json").write_text("[1,2]")
    (path / "bad_tail.json").write_text('{"entry":[]} tail')
    (path / "bad_blank.json").write_text(" \n")
    (path / "zero_bytes.json").write_text("")
    (path / "hospitalInformation0.json").write_text("")
    (path / "empty.json").write_text("{}\n\n")
    (path / "hospitalInformation123.json").write_text("{}")
    (path / "practitionerInformation123.json").write_text("{}")
    (path / "notes.txt").write_text("{}")
    return str(path)


@pytest.fixture(scope="module")
def staged(spark, folder):
    return bundles.stage_bundles(bundles.read_bundles(spark, folder))


@pytest.fixture(scope="module")
def flat(staged):
    return {name: {r[0]: r.asDict() for r in df.collect()} for name, df in flatten.flatten_all(staged.resources).items()}


def names(df):
    return sorted(r.bundle_id.rsplit("/", 1)[-1] for r in df.select("bundle_id").collect())


def test_only_patient_files_are_read(spark, folder):
    assert names(bundles.read_bundles(spark, folder)) == sorted(
        [*FILES, "bad_object.json", "bad_list.json", "bad_tail.json", "bad_blank.json", "zero_bytes.json", "empty.json"]
    )


def test_limit_takes_the_first_names(spark, folder):
    assert names(bundles.read_bundles(spark, folder, limit=3)) == ["Ann_1.json", "Bob_2.json", "Cay_3.json"]
    assert len(names(bundles.read_bundles(spark, folder, limit=100))) == 11


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for folder, drug in (("a", "A"), ("b", "B")):
        (tmp_path / folder).mkdir()
        medication = {"resourceType": "Medication", "id": "m1", "code": {"coding": [{"code": drug}]}}
        request = {"resourceType": "MedicationRequest", "id": f"r{drug}", "medicationReference": {"reference": "urn:uuid:m1"}}
        document = {"resourceType": "Bundle", "entry": [{"resource": medication}, {"resource": request}]}
        (tmp_path / folder / "p.json").write_text(json.dumps(document))
    folders = [str(tmp_path / "a"), str(tmp_path / "b")]
    found = bundles.read_bundles(spark, folders)
    requests = flatten.flatten_medication_requests(bundles.stage_bundles(found).resources)
    assert {(r.medication_request_id, r.medication_code) for r in requests.collect()} == {("rA", "A"), ("rB", "B")}
    (first,) = bundles.read_bundles(spark, folders, limit=1).collect()
    assert first.bundle_id.endswith("/a/p.json")


@pytest.mark.parametrize(
    ("text", "good"),
    [('{"entry":[]}', True), ("{}", True), (' {"entry":[]} \n', True), ('{"entry":[]}{"entry":[]}', False), ('{"entry":[]},{"a":1}', False),
     ('{"entry":[]}}', False), ('{"entry":[]}]', False), ("[]", False), ("null", False), ('{"entry":{"resource":1}}', False), ("", False)],
)
def test_only_whole_documents_are_good(spark, text, good):
    df = spark.createDataFrame([("x", text)], "bundle_id string, value string")
    assert bundles.decode_bundles(df).first()["bad"] is not good


def test_lost_fields_are_reported(spark):
    def observation(value):
        return json.dumps({"resourceType": "Observation", "id": "o", "valueQuantity": {"value": value, "unit": "u"}})

    texts = [observation(7.5), observation("7.5"), observation("high"), json.dumps({"resourceType": "Patient", "name": {"family": "x"}})]
    rows = [("b", n, json.loads(t)["resourceType"], t) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "bundle_id string, pos int, resource_type string, resource string")
    found = {r["pos"]: r["reason"] for r in flatten.unreadable(df).collect()}
    assert found == {2: "value is not a number", 3: "field of another type"}
    values = [r["value_numeric"] for r in flatten.flatten_observations(df).collect()]
    assert sorted(values, key=str) == [7.5, 7.5, None]


def test_empty_folder_is_refused(spark, tmp_path):
    (tmp_path / "hospitalInformation1.json").write_text("{}")
    with pytest.raises(ValueError, match="no patient bundles"):
        bundles.require_bundles(bundles.read_bundles(spark, str(tmp_path)))


def test_bad_documents_are_set_aside(spark, folder, staged):
    expected = {
        "bad_object.json": ("malformed document", "{bad"),
        "bad_list.json": ("not a JSON object", "[1,2]"),
        "bad_tail.json": ("text after the document", '{"entry":[]} tail'),
        "bad_blank.json": ("not a JSON object", " \n"),
        "zero_bytes.json": ("empty file", ""),
    }
    for quarantined in (staged.quarantine, bundles.split_bad_bundles(bundles.read_bundles(spark, folder))[1]):
        assert {r.bundle_id.rsplit("/", 1)[-1]: (r.reason, r.value) for r in quarantined.collect()} == expected
    good = bundles.split_bad_bundles(bundles.read_bundles(spark, folder))[0]
    assert names(good) == sorted([*FILES, "empty.json"])


def test_report_counts(staged):
    report = {r["item"]: r.n for r in bundles.ingest_report(staged, flatten.flatten_all(staged.resources)).collect()}
    assert report == {
        "bundles_ok": 6, "bundles_failed": 5, "patients": 2, "encounters": 1, "conditions": 1,
        "medication_requests": 7, "observations": 1 + 2 + 4 + 1 + 1 + 1 + 1 + 1,
    }


def test_staging_equals_direct_reading(spark, folder, staged):
    direct = bundles.explode_resources(bundles.decode_bundles(bundles.read_bundles(spark, folder)))
    columns = ["bundle_id", "pos", "full_url", "resource_type", "resource"]
    assert sorted(map(str, direct.select(columns).collect())) == sorted(map(str, staged.resources.select(columns).collect()))


def test_staging_only_the_needed_types(spark, folder, staged):
    few = bundles.stage_bundles(bundles.read_bundles(spark, folder), types=flatten.SOURCE_TYPES)
    assert few.resources.count() == staged.resources.count() - 1  # the untyped one
    assert few.bundles.count() == staged.bundles.count() == 11


def test_dropped_types_are_counted(spark, folder, staged, rows):
    few = bundles.stage_bundles(bundles.read_bundles(spark, folder), types=("Patient", "Observation"))
    assert few.metrics == {"bundles_ok": 6, "bundles_failed": 5, "entries": 27, "entries_kept": 13, "entries_dropped": 14}
    assert staged.metrics == {"bundles_ok": 6, "bundles_failed": 5, "entries": 27, "entries_kept": 27, "entries_dropped": 0}
    for per_bundle in (False, True):
        assert rows(bundles.resource_type_counts(few, per_bundle)) == rows(bundles.resource_type_counts(staged, per_bundle))
    assert rows(bundles.resource_type_counts(few)) == rows(bundles.resource_type_counts(staged.entries))


def test_staging_nothing(spark):
    staged = bundles.stage_bundles(spark.createDataFrame([], "bundle_id string, value binary"), types=("Patient",))
    assert set(staged.metrics.values()) <= {0}
    assert staged.bundles.count() == 0 and bundles.resource_type_counts(staged).count() == 0


def test_bytes_that_are_not_utf8(spark, tmp_path):
    good, bad = b'{"entry":[{"resource":{"resourceType":"Patient","id":"p\xc3\xa91"}}]}', b'{"entry":[{"resource":{"id":"p\xff1"}}]}'
    for name, content in {"good x+%41.json": good, "bad x+%41.json": bad, "zero +%.json": b""}.items():
        (tmp_path / name).write_bytes(content)
    found = bundles.read_bundles(spark, str(tmp_path))
    staged = bundles.stage_bundles(found)
    ((patient,),) = staged.resources.select(F.get_json_object("resource", "$.id")).collect()
    assert patient == "pé1"
    for quarantined in (staged.quarantine, bundles.split_bad_bundles(found)[1]):
        got = {r.reason: (r.raw, r.value, r.message) for r in bundles.failure_messages(quarantined).collect()}
        assert got == {
            "not UTF-8": (bad, bad.decode(errors="replace"), "UnicodeDecodeError: 'utf-8' codec can't decode byte 0xff in position 30: invalid start byte"),
            "empty file": (None, "", "JSONDecodeError: Expecting value: line 1 column 1 (char 0)"),
        }
    index = {r["name"]: r["length"] for r in bundles.file_index(spark, str(tmp_path)).collect()}
    assert index == {"good x+%41.json": len(good), "bad x+%41.json": len(bad), "zero +%.json": 0}


def test_patient(flat):
    p = flat["patients"]["p1"]
    assert (p["given_name"], p["family_name"], p["marital_status"], p["city"], p["race"]) == ("Ann B", "First", "M", "Boston", None)
    assert flat["patients"]["p5"]["given_name"] is None and flat["patients"]["p5"]["city"] is None


def test_encounter_and_condition(flat):
    e = flat["encounters"]["e1"]
    assert (e["patient_id"], e["class_code"], e["class_display"], e["provider_id"], e["end_time"]) == ("p1", "AMB", None, "o1", None)
    c = flat["conditions"]["c1"]
    assert (c["patient_id"], c["encounter_id"], c["code"], c["clinical_status"], c["abatement_date"]) == ("p1", "e1", "59621000", "active", None)


@pytest.mark.parametrize(
    ("request_id", "expected"),
    [
        ("m1", ("rx", "1", "Inline")),
        ("m2", ("rx", "B", "Last")),
        ("m3", ("rx", "B", "Last")),
        ("m4", (None, "", "Only text")),
        ("m5", (None, None, None)),
        ("m6", (None, "7", "Kept")),
        ("m7", (None, None, None)),
    ],
)
def test_medication_resolution(flat, request_id, expected):
    m = flat["medication_requests"][request_id]
    assert (m["code_system"], m["medication_code"], m["medication_display"]) == expected


VALUE_COLUMNS = ("parent_observation_id", "loinc_code", "value_numeric", "value_text", "value_code", "unit")


@pytest.mark.parametrize(
    ("row_id", "expected"),
    [
        ("o1", (None, "4548-4", 6.1, None, None, "%")),
        ("bp_0", ("bp", "8480-6", 120.0, None, None, "mm[Hg]")),
        ("bp_1", ("bp", "8462-4", 80.5, None, None, "mm[Hg]")),
        ("sv_0", ("sv", "q1", None, "Said", "LA1", None)),
        ("sv_1", ("sv", "q2", None, "Shown", "LA2", None)),
        ("sv_2", ("sv", "q3", None, "free", None, None)),
        ("sv_3", ("sv", "q4", None, None, None, None)),
        ("both_0", ("both", "8480-6", 120.0, None, None, "mm[Hg]")),
        ("hollow", (None, None, None, None, None, None)),
        ("text", (None, None, None, "Shown", "LA9", None)),
        ("note", (None, None, None, "narrative", None, None)),
        (None, (None, "8480-6", 120.0, None, None, "mm[Hg]")),
    ],
)
def test_observation_rows(flat, row_id, expected):
    assert tuple(flat["observations"][row_id][c] for c in VALUE_COLUMNS) == expected


def test_observations_without_a_value_give_no_row(flat):
    assert not {"null", "bool", "int", "both", "bp", "sv"} & set(flat["observations"])


def test_type_counts(spark, folder, staged, rows):
    entries = bundles.explode_entries(bundles.decode_bundles(bundles.read_bundles(spark, folder)))
    counts = {r["resource_type"]: r["n"] for r in rows(bundles.resource_type_counts(entries))}
    assert rows(bundles.resource_type_counts(staged.entries)) == rows(bundles.resource_type_counts(entries))
    assert counts == {"Patient": 2, "Encounter": 1, "Condition": 1, "MedicationRequest": 7, "Medication": 3, "Observation": 11, "Unknown": 2}
    assert bundles.resource_type_totals(entries).first().asDict() == {"entries": 27, "resource_types": 7}


def test_diagnostics(staged, rows):
    shapes = {r["shape"]: r["n"] for r in rows(inspect.observation_shapes(staged.resources))}
    assert shapes == {"valueQuantity": 4, "component": 4, "valueBoolean": 1, "valueCodeableConcept": 1, "valueString": 1}
    (unvalued,) = rows(inspect.unvalued_observations(staged.resources))
    assert unvalued["bundle_id"].endswith("/Dan_4.json")
    assert {r["field"] for r in rows(inspect.unvalued_fields(staged.resources))} == {"resourceType", "id", "valueBoolean"}
    observations = flatten.flatten_observations(staged.resources)
    assert inspect.empty_observation_counts(observations).first().asDict() == {
        "empty_rows": 2, "from_components": 1, "not_from_components": 1,
    }


def test_find_resource(staged):
    found = inspect.find_resource(staged.resources, "Medication", full_url="urn:uuid:drug")
    assert found.count() == 2
    assert inspect.find_resource(staged.resources, "Observation", "sv", bundle_contains="Dan").count() == 1
    assert inspect.find_resource(staged.resources, "Observation", "sv", bundle_contains="Ann").count() == 0
    forms = {r.medication_request_id: (r.has_inline, r.has_reference) for r in inspect.medication_forms(staged.resources).collect()}
    assert forms["m1"] == (True, False) and forms["m2"] == (False, True) and forms["m6"] == (True, True)
    components = {r.observation_id: r.components for r in inspect.component_counts(staged.resources).collect()}
    assert components["sv"] == 4 and components["note"] == 0


def test_parsed_round_trip(spark, staged, tmp_path, rows):
    records = flatten.flatten_all(staged.resources)
    parsed.write_parsed(records, str(tmp_path))
    parsed.check_inputs(spark, str(tmp_path))
    for name, df in records.items():
        back = parsed.read_parsed(spark, str(tmp_path), name)
        assert back.columns == schemas.RECORDS[name].names
        assert rows(back) == rows(df)


def test_flatteners_have_no_python_and_no_shuffle(staged):
    for name, df in flatten.flatten_all(staged.resources).items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan
        assert "Exchange" not in plan
        assert "resource_type#" in plan[plan.index("PartitionFilters"):]
    joined = flatten.flatten_medication_requests(staged.resources.drop("linked"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in joined and "Exchange" in joined


def test_references_are_followed_inside_the_row(spark, folder):
    resources = bundles.explode_resources(bundles.decode_bundles(bundles.read_bundles(spark, folder)))
    carried = flatten.flatten_medication_requests(resources)
    documents = bundles.decode_bundles(spark.read.text(folder, wholetext=True).select(F.lit("x").alias("bundle_id"), "value"))
    plan = flatten.flatten_medication_requests(bundles.explode_resources(documents))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    joined = flatten.flatten_medication_requests(resources.drop("linked"))
    assert sorted(map(str, carried.collect())) == sorted(map(str, joined.collect()))
    few = bundles.stage_bundles(bundles.read_bundles(spark, folder), types=("MedicationRequest",))
    alone = flatten.flatten_medication_requests(few.resources)  # the medications themselves are not staged
    assert sorted(map(str, alone.collect())) == sorted(map(str, joined.collect()))


def test_requests_without_lookup_do_not_share_a_key(staged):
    """The join key of requests needing no lookup spreads by position."""
    plan = flatten.flatten_medication_requests(staged.resources.drop("linked"))._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(pos" in plan


def test_null_counts(staged):
    medications = flatten.flatten_medication_requests(staged.resources)
    counts = profile.null_counts(medications, ["medication_display"]).first()
    assert (counts.n, counts.medication_display_nulls) == (7, 2)
    assert medications.filter(F.col("medication_display").isNull()).count() == 2


def test_variants_give_the_same_diagnostics(staged, rows):
    parsed_once = inspect.as_variants(staged.resources)
    assert "resource" not in parsed_once.columns
    for diagnose in (inspect.observation_shapes, inspect.unvalued_codes, inspect.unvalued_fields, inspect.medication_forms, inspect.component_counts):
        assert rows(diagnose(parsed_once)) == rows(diagnose(staged.resources)), diagnose.__name__
    assert inspect.find_resource(parsed_once, "Patient", "p1").count() == 1


def test_documents_are_made_in_all_tasks(spark, tmp_path):
    from bindings import documents

    spark.range(1000).selectExpr("id AS c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    made = documents.bundles(spark, str(tmp_path), "customer")
    filled = made.groupBy(F.spark_partition_id()).count()
    assert filled.count() >= spark.sparkContext.defaultParallelism and made.count() == 1000
