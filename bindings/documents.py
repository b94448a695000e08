"""Patient bundles as JSON text, derived row by row from the driver's tables.

One bundle per customer (patients), per order (encounter, condition, medications) and per
event (observations), so a bundle stays small however often a key occurs. The relations at
the end state in SQL which flat rows those documents must give.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import oracle, shapes


def _text(template: str) -> str:
    """SQL string expression; ``@name@`` inserts a column."""
    parts = re.split(r"@(\w+)@", template)
    out = []
    for i, part in enumerate(parts):
        if i % 2:
            out.append(f"cast({part} as string)")
        elif part:
            out.append("'" + part + "'")
    return " || ".join(out)


def _case(selector: str, options: dict[int, str]) -> str:
    """One of several pieces of text, or nothing."""
    branches = "".join(f" WHEN {n} THEN {_text(t)}" for n, t in options.items())
    return f"(CASE {selector}{branches} ELSE '' END)"


def _if(condition: str, template: str) -> str:
    """A piece of text, or nothing."""
    return f"(CASE WHEN {condition} THEN {_text(template)} ELSE '' END)"


def _entry_if(condition: str, template: str) -> str:
    """A whole entry, or NULL so that joining skips it."""
    return f"(CASE WHEN {condition} THEN {_text(template)} END)"


def _join(*parts: str) -> str:
    return " || ".join(p if p.startswith("(CASE") else _text(p) for p in parts)


def _bundle(entries: list[str]) -> str:
    return f"""'{{"resourceType":"Bundle","id":"' || cast(k as string) || '","entry":[' || concat_ws(',', {", ".join(entries)}) || ']}}'"""


CUSTOMER_COLUMNS = {
    "k": "c_custkey",
    "k2": "c_custkey % 2",
    "k4": "c_custkey % 4",
    "k100": "c_custkey % 100",
    "born": "cast(date '1930-01-01' + cast((c_custkey * 37) % 32000 as int) as string)",
}
_EXT = "http://hl7.org/fhir/us/core/StructureDefinition/us-core-"
_PATIENT = _join(
    '{"fullUrl":"urn:uuid:p@k@","resource":{"resourceType":"Patient","id":"p@k@","gender":"male","birthDate":"@born@"',
    _if("k % 7 = 0", ',"deceasedDateTime":"2020-01-02T03:04:05-05:00"'),
    _case("CASE WHEN k % 31 = 0 THEN 0 WHEN k % 4 = 0 THEN 1 ELSE 2 END", {
        1: ',"name":[{"given":[],"family":"F@k100@"}]',
        2: ',"name":[{"given":["G@k@","M@k4@"],"family":"F@k100@"},{"given":["Alias"],"family":"Z"}]',
    }),
    _if("k % 3 <> 0", ',"maritalStatus":{"coding":[{"code":"M"},{"code":"S"}]}'),
    _case("k % 5", {
        0: ',"extension":[{"url":"' + _EXT + 'race","extension":[{"url":"text"}]},'
        '{"url":"x/us-core-race","extension":[{"url":"ombCategory","valueCoding":{"display":"Second"}}]}]',
        1: ',"extension":[{"url":"' + _EXT + 'race","extension":[{"url":"ombCategory","valueCoding":{}},'
        '{"url":"ombCategory","valueCoding":{"display":"Late"}}]}]',
        2: ',"extension":[{"url":"' + _EXT + 'race-other"},{"url":"' + _EXT + 'ethnicity"}]',
        3: ',"extension":[{"url":"' + _EXT + 'race","extension":[{"url":"ombCategory","valueCoding":{"display":"R@k4@"}}]},'
        '{"url":"' + _EXT + 'ethnicity","extension":[{"url":"ombCategory","valueCoding":{"display":"E@k2@"}}]}]',
    }),
    _if("k % 6 <> 0", ',"address":[{"city":"C@k4@","state":"MA","postalCode":"0@k100@","country":"US"},{"city":"Other"}]'),
    "}}",
)
CUSTOMER_BUNDLE = _bundle([
    _PATIENT,
    _entry_if("k % 13 = 0", '{"fullUrl":"u"}'),
    _entry_if("k % 29 = 0", '{"resource":{"id":"x"}}'),
])
CUSTOMER_DOC = (
    "CASE WHEN k % 17 = 0 THEN '{bad' || cast(k as string) WHEN k % 19 = 0 THEN '[1,2]' "
    f"WHEN k % 23 = 0 THEN '{{}}' ELSE {CUSTOMER_BUNDLE} END"
)

ORDER_COLUMNS = {
    "k": "o_orderkey",
    "prev": "o_orderkey - 1",
    "k5": "o_orderkey % 5",
    "p": "o_custkey",
    "day": "cast(cast(o_orderdate as date) as string)",
}
_SUBJECT = _case("k % 4", {
    0: ',"subject":{"reference":"urn:uuid:p@p@"}',
    1: ',"subject":{"reference":"Patient/p@p@"}',
    2: ',"subject":{"reference":"Patient?identifier=https://x/ids|p@p@"}',
    3: ',"subject":{"reference":"p@p@"}',
})
_ENCOUNTER = _join(
    '{"fullUrl":"urn:uuid:e@k@","resource":{"resourceType":"Encounter","id":"e@k@","status":"finished"',
    _SUBJECT,
    _if("k % 101 <> 0", ',"class":{"code":"AMB","display":"ambulatory"}'),
    ',"type":[{"coding":[{"code":"t@k5@","display":"Type @k5@"},{"code":"zz"}]},{"coding":[{"code":"late"}]}]',
    _if("k % 2 = 0", ',"reasonCode":[{"coding":[{"code":"r@k5@","display":"Reason"}]}]'),
    ',"period":{"start":"@day@T01:02:03-05:00"',
    _if("k % 11 <> 0", ',"end":"@day@T02:02:03-05:00"'),
    "}",
    _case("k % 3", {
        0: ',"serviceProvider":{"reference":"Organization?identifier=a=org@k5@"}',
        1: ',"serviceProvider":{"reference":"http://h/Organization/org@k5@"}',
    }),
    "}}",
)
_CONDITION = _join(
    '{"resource":{"resourceType":"Condition","id":"c@k@"',
    _SUBJECT,
    ',"encounter":{"reference":"Encounter/e@k@"}',
    _if("k % 8 <> 0", ',"code":{"coding":[{"system":"http://snomed.info/sct","code":"59621000","display":"Hypertension (disorder)"},{"code":"I10"}]}'),
    _if("k % 5 <> 0", ',"clinicalStatus":{"coding":[{"code":"active"}]}'),
    ',"verificationStatus":{"coding":[{"code":"confirmed"}]},"onsetDateTime":"@day@T00:00:00Z"',
    _if("k % 3 = 0", ',"abatementDateTime":"@day@T10:00:00Z"'),
    ',"recordedDate":"@day@T00:00:01Z"}}',
)


def _medication(condition: str, letter: str, identity: str = "m@k@") -> str:
    low = letter.lower()
    return _entry_if(
        condition,
        '{"resource":{"resourceType":"Medication","id":"' + identity + '","code":{"coding":'
        '[{"system":"sys-' + low + '","code":"' + letter + '@k@","display":"Drug ' + letter + '"}]}}}',
    )


_REQUEST = _join(
    '{"resource":{"resourceType":"MedicationRequest","id":"mr@k@","status":"active","intent":"order"',
    _SUBJECT,
    ',"encounter":{"reference":"urn:uuid:e@k@"}',
    _case("k % 6", {
        0: ',"medicationCodeableConcept":{"coding":[{"system":"sys-inline","code":"I@k@","display":"Inline drug"}]},'
        '"medicationReference":{"reference":"urn:uuid:m@k@"}',
        1: ',"medicationReference":{"reference":"urn:uuid:m@k@"}',
        2: ',"medicationReference":{"reference":"urn:uuid:m@prev@"}',
        3: ',"medicationCodeableConcept":{"coding":[{"code":"","display":"Inline only"}]},'
        '"medicationReference":{"reference":"Medication/m@k@"}',
        4: ',"medicationCodeableConcept":{"coding":[{"display":"Inline only"}]},'
        '"medicationReference":{"reference":"urn:uuid:none"}',
    }),
    ',"authoredOn":"@day@T05:00:00-05:00"',
    _if("k % 2 = 0", ',"dosageInstruction":[{"text":"once"},{"text":"more"}]'),
    "}}",
)
ORDER_DOC = _bundle([
    _ENCOUNTER,
    _REQUEST,
    _CONDITION,
    _medication("k % 6 = 0", "Z"),
    _medication("k % 6 = 1", "A"),
    _medication("k % 6 = 1", "B"),
    _medication("k % 6 = 3", "C"),
    _medication("k % 6 = 5", "N", ""),
])

EVENT_COLUMNS = {"k": "event_id", "u": "user_id", "day": "cast(cast(ts as date) as string)", "v": "value", "w": "value + 1"}
_ANSWER = '"coding":[{"system":"http://loinc.org","code":"LA@k@","display":"Shown"}]'
_OBSERVATION = _join(
    '{"resource":{"resourceType":"Observation","id":"o@k@","status":"final",'
    '"subject":{"reference":"urn:uuid:p@u@"},"encounter":{"reference":"Encounter/e@k@"},'
    '"effectiveDateTime":"@day@T01:00:00Z","issued":"@day@T02:00:00Z"',
    _if("k % 3 <> 0", ',"category":[{"coding":[{"code":"laboratory"},{"code":"x"}]}]'),
    ',"code":{"coding":[{"code":"4548-4","display":"HbA1c"},{"code":"y"}],"text":"A1c"}',
    _case("k % 10", {
        0: ',"valueQuantity":{"value":@v@,"unit":"%"}',
        1: ',"component":[{"code":{"coding":[{"code":"8480-6","display":"Systolic"}]},"valueQuantity":{"value":@v@,"unit":"mm[Hg]"}},'
        '{"code":{"coding":[{"code":"8462-4","display":"Diastolic"}]},"valueQuantity":{"value":@w@,"unit":"mm[Hg]"}}]',
        2: ',"component":[{"code":{"coding":[{"code":"q0"}]},"valueCodeableConcept":{"text":"Said",' + _ANSWER + "}},"
        '{"code":{"coding":[{"code":"q1"}]},"valueCodeableConcept":{' + _ANSWER + "}},"
        '{"code":{"coding":[{"code":"q2"}]},"valueString":"free"},{"code":{"coding":[{"code":"q3"}]}}]',
        3: ',"valueQuantity":{"value":@v@},"component":[{"valueQuantity":{"value":@w@}}]',
        4: ',"valueQuantity":{}',
        5: ',"valueQuantity":null',
        6: ',"valueBoolean":true',
        7: ',"valueCodeableConcept":{"text":"",' + _ANSWER + "}",
        8: ',"valueString":"note"',
        9: ',"component":[],"valueInteger":3',
    }),
    "}}",
)
EVENT_DOC = _bundle([_OBSERVATION])

DOCUMENTS = {
    "customer": ("c", CUSTOMER_COLUMNS, CUSTOMER_DOC),
    "orders": ("o", ORDER_COLUMNS, ORDER_DOC),
    "events": ("v", EVENT_COLUMNS, EVENT_DOC),
}


def bundles(spark: SparkSession, sf_dir: str, *sources: str) -> DataFrame:
    """(bundle_id, value) of the documents made from the named tables (default: all).

    A document takes many times the bytes of its row, and a table's file may be read by one task. The rows are
    therefore dealt to all cores before documents are made of them.
    """
    parts, tasks = [], 3 * spark.sparkContext.defaultParallelism
    for source in sources or tuple(DOCUMENTS):
        prefix, columns, document = DOCUMENTS[source]
        rows = shapes.table(spark, sf_dir, source).select(
            *[F.expr(e).alias(name) for name, e in columns.items()]
        ).repartition(tasks)
        parts.append(
            rows.select(F.expr(_text(f"{prefix}@k@")).alias("bundle_id"), F.expr(document).alias("value"))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- what the documents must give ---

READABLE = "c_custkey % 17 <> 0 AND c_custkey % 19 <> 0"
FILLED = READABLE + " AND c_custkey % 23 <> 0"

oracle.RELATIONS |= {
    "doc_patients": f"""SELECT 'p' || c_custkey AS patient_id,
  CASE WHEN c_custkey % 31 <> 0 AND c_custkey % 4 <> 0 THEN 'G' || c_custkey || ' M' || c_custkey % 4 END AS given_name,
  CASE WHEN c_custkey % 31 <> 0 THEN 'F' || c_custkey % 100 END AS family_name, 'male' AS gender,
  {CUSTOMER_COLUMNS["born"]} AS birth_date,
  CASE WHEN c_custkey % 7 = 0 THEN '2020-01-02T03:04:05-05:00' END AS deceased_date,
  CASE WHEN c_custkey % 3 <> 0 THEN 'M' END AS marital_status,
  CASE c_custkey % 5 WHEN 0 THEN 'Second' WHEN 3 THEN 'R' || c_custkey % 4 END AS race,
  CASE c_custkey % 5 WHEN 3 THEN 'E' || c_custkey % 2 END AS ethnicity,
  CASE WHEN c_custkey % 6 <> 0 THEN 'C' || c_custkey % 4 END AS city,
  CASE WHEN c_custkey % 6 <> 0 THEN 'MA' END AS state,
  CASE WHEN c_custkey % 6 <> 0 THEN '0' || c_custkey % 100 END AS postal_code,
  CASE WHEN c_custkey % 6 <> 0 THEN 'US' END AS country
FROM customer WHERE {FILLED}""",
    "doc_encounters": """SELECT 'e' || o_orderkey AS encounter_id, 'p' || o_custkey AS patient_id, 'finished' AS status,
  CASE WHEN o_orderkey % 101 <> 0 THEN 'AMB' END AS class_code,
  CASE WHEN o_orderkey % 101 <> 0 THEN 'ambulatory' END AS class_display,
  't' || o_orderkey % 5 AS type_code, 'Type ' || o_orderkey % 5 AS type_display,
  CASE WHEN o_orderkey % 2 = 0 THEN 'r' || o_orderkey % 5 END AS reason_code,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Reason' END AS reason_display,
  cast(o_orderdate AS date) || 'T01:02:03-05:00' AS start_time,
  CASE WHEN o_orderkey % 11 <> 0 THEN cast(o_orderdate AS date) || 'T02:02:03-05:00' END AS end_time,
  CASE o_orderkey % 3 WHEN 0 THEN 'org' || o_orderkey % 5 WHEN 1 THEN '/h/Organization/org' || o_orderkey % 5 END AS provider_id
FROM orders""",
    "doc_conditions": """SELECT 'c' || o_orderkey AS condition_id, 'p' || o_custkey AS patient_id,
  'e' || o_orderkey AS encounter_id,
  CASE WHEN o_orderkey % 8 <> 0 THEN 'http://snomed.info/sct' END AS code_system,
  CASE WHEN o_orderkey % 8 <> 0 THEN '59621000' END AS code,
  CASE WHEN o_orderkey % 8 <> 0 THEN 'Hypertension (disorder)' END AS display,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'active' END AS clinical_status, 'confirmed' AS verification_status,
  cast(o_orderdate AS date) || 'T00:00:00Z' AS onset_date,
  CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderdate AS date) || 'T10:00:00Z' END AS abatement_date,
  cast(o_orderdate AS date) || 'T00:00:01Z' AS recorded_date
FROM orders""",
    "doc_medication_lookup": """SELECT 'o' || o_orderkey AS bundle_id, 'm' || o_orderkey AS medication_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'sys-z' WHEN 1 THEN 'sys-b' ELSE 'sys-c' END AS code_system,
  CASE o_orderkey % 6 WHEN 0 THEN 'Z' WHEN 1 THEN 'B' ELSE 'C' END || o_orderkey AS medication_code
FROM orders WHERE o_orderkey % 6 IN (0, 1, 3)""",
    "doc_medication_requests": """SELECT 'mr' || o_orderkey AS medication_request_id, 'p' || o_custkey AS patient_id,
  'e' || o_orderkey AS encounter_id, 'active' AS status, 'order' AS intent,
  CASE o_orderkey % 6 WHEN 0 THEN 'sys-inline' WHEN 1 THEN 'sys-b' WHEN 3 THEN 'sys-c' END AS code_system,
  CASE o_orderkey % 6 WHEN 0 THEN 'I' || o_orderkey WHEN 1 THEN 'B' || o_orderkey WHEN 3 THEN 'C' || o_orderkey END AS medication_code,
  CASE o_orderkey % 6 WHEN 0 THEN 'Inline drug' WHEN 1 THEN 'Drug B' WHEN 3 THEN 'Drug C' WHEN 4 THEN 'Inline only' END AS medication_display,
  cast(o_orderdate AS date) || 'T05:00:00-05:00' AS authored_on,
  CASE WHEN o_orderkey % 2 = 0 THEN 'once' END AS dosage_text
FROM orders""",
    # One row per part: shape (event_id % 10), index (-1 for a value on the observation itself).
    "doc_parts": """SELECT * FROM (VALUES
  (0, -1, '4548-4', 'HbA1c', 'v', NULL, false, '%'),
  (1, 0, '8480-6', 'Systolic', 'v', NULL, false, 'mm[Hg]'), (1, 1, '8462-4', 'Diastolic', 'w', NULL, false, 'mm[Hg]'),
  (2, 0, 'q0', NULL, NULL, 'Said', true, NULL), (2, 1, 'q1', NULL, NULL, 'Shown', true, NULL),
  (2, 2, 'q2', NULL, NULL, 'free', false, NULL), (2, 3, 'q3', NULL, NULL, NULL, false, NULL),
  (3, 0, NULL, NULL, 'w', NULL, false, NULL),
  (4, -1, '4548-4', 'HbA1c', NULL, NULL, false, NULL),
  (7, -1, '4548-4', 'HbA1c', NULL, 'Shown', true, NULL),
  (8, -1, '4548-4', 'HbA1c', NULL, 'note', false, NULL)
) AS parts(shape, idx, loinc_code, loinc_display, figure, value_text, coded, unit)""",
    "doc_observations": """SELECT 'o' || event_id || CASE WHEN idx >= 0 THEN '_' || idx ELSE '' END AS observation_id,
  CASE WHEN idx >= 0 THEN 'o' || event_id END AS parent_observation_id, 'p' || user_id AS patient_id,
  'e' || event_id AS encounter_id, 'final' AS status, CASE WHEN event_id % 3 <> 0 THEN 'laboratory' END AS category,
  loinc_code, loinc_display, CASE figure WHEN 'v' THEN value WHEN 'w' THEN value + 1 END AS value_numeric,
  value_text, CASE WHEN coded THEN 'LA' || event_id END AS value_code,
  CASE WHEN coded THEN 'http://loinc.org' END AS value_code_system, unit,
  cast(ts AS date) || 'T01:00:00Z' AS effective_date, cast(ts AS date) || 'T02:00:00Z' AS issued_date
FROM events JOIN doc_parts ON event_id % 10 = shape""",
}
