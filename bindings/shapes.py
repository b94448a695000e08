"""Bronze record sets derived from the driver's tables.

Each column is one SQL expression valid in Spark and in DuckDB (``{TS}`` stands for the
zone-less timestamp type), so both sides start from the same rows and only the operators
under test differ. ``batch`` numbers the load batches of a key: some keys are loaded twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fhirlake import schemas
from fhirlake.functions import rules

AS_OF = "2025-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(selector: str, options: list[str | None]) -> str:
    """CASE over ``selector`` = 0, 1, 2, ..."""
    branches = "".join(
        f" WHEN {i} THEN '{o}'" for i, o in enumerate(options) if o is not None
    )
    return f"CASE {selector}{branches} END"


def _text(prefix: str, expression: str) -> str:
    return f"'{prefix}' || cast({expression} as string)"


_BATCH_TIME = "CASE WHEN batch = 2 THEN {TS} '2024-02-01 00:00:00' ELSE {TS} '2024-01-01 00:00:00' END"
_BIRTH = "date '1930-01-01' + cast((c_custkey * 37) % 32000 as int)"

PATIENTS = {
    "patient_id": _text("p", "c_custkey"),
    "given_name": "c_name",
    "family_name": _text("F", "c_custkey % 100"),
    "gender": "CASE c_mktsegment WHEN 'BUILDING' THEN 'male' WHEN 'AUTOMOBILE' THEN 'FEMALE' "
    "WHEN 'MACHINERY' THEN 'Female' WHEN 'HOUSEHOLD' THEN 'Unknown' "
    "ELSE CASE WHEN c_custkey % 50 = 0 THEN 'n/a' ELSE 'other' END END",
    "birth_date": f"CASE WHEN c_custkey % 97 <> 0 THEN {_BIRTH} END",
    "deceased_date": "CASE WHEN c_custkey % 7 = 0 THEN "
    f"cast({_BIRTH} + cast(200 + c_custkey % 3000 as int) as {{TS}}) END",
    "marital_status": _pick("c_custkey % 4", ["M", "S", "D", None]),
    "race": _pick("c_custkey % 3", ["White", "Asian", None]),
    "ethnicity": _pick("c_custkey % 2", ["Hispanic", "Non-Hispanic"]),
    "city": _text("City", "c_custkey % 20") + " || '-' || cast(batch as string)",
    "state": "c_mktsegment",
    "postal_code": _text("Z", "c_nationkey"),
    "country": "'US'",
    "load_timestamp": _BATCH_TIME,
    "load_batch_id": _text("b", "batch"),
}

_START = (
    "o_orderdate + (o_orderkey % 1440) * interval '1' minute + (o_orderkey % 60) * interval '1' second"
)

ENCOUNTERS = {
    "encounter_id": _text("e", "o_orderkey"),
    "patient_id": _text("p", "o_custkey"),
    "status": "CASE WHEN batch = 2 THEN 'amended' ELSE o_orderstatus END",
    "class_code": "CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'XX' "
    "WHEN o_orderpriority = '1-URGENT' THEN 'EMER' WHEN o_orderpriority = '2-HIGH' THEN 'IMP' "
    "WHEN o_orderpriority = '3-MEDIUM' THEN 'AMB' WHEN o_orderpriority = '5-LOW' THEN 'VR' ELSE 'HH' END",
    "class_display": "o_orderpriority",
    "type_code": _text("t", "o_orderkey % 5"),
    "type_display": _text("Type ", "o_orderkey % 5"),
    "reason_code": "CASE WHEN o_orderkey % 2 = 0 THEN 'r1' END",
    "reason_display": "CASE WHEN o_orderkey % 2 = 0 THEN 'Reason' END",
    "start_time": f"CASE WHEN o_orderkey % 103 <> 0 THEN {_START} END",
    "end_time": f"CASE WHEN o_orderkey % 11 <> 0 THEN {_START} + (o_orderkey % 9) * interval '1' day "
    "+ (o_orderkey % 90) * interval '1' minute + 31 * interval '1' second END",
    "provider_id": _text("org", "o_orderkey % 7"),
    # Every other reloaded key has the same time in both batches, so the batch id decides.
    "load_timestamp": "CASE WHEN batch = 2 AND o_orderkey % 12 <> 0 THEN {TS} '2024-02-01 00:00:00' "
    "ELSE {TS} '2024-01-01 00:00:00' END",
    "load_batch_id": _text("b", "batch"),
}

# Lines repeat (order, line number): the ship date is the load time, and where it repeats
# too, a batch label made of part, supplier and price decides.
_LINE_BATCH = (
    "lpad(cast(l_partkey as string), 12, '0') || '_' || lpad(cast(l_suppkey as string), 12, '0') || '_' || "
    "lpad(cast(cast(round(l_extendedprice * 100) as bigint) as string), 14, '0')"
)
_LINE_ID = "cast(l_orderkey as string) || '-' || cast(l_linenumber as string)"
_FLAG_CODES = [code for codes, _ in rules.CONDITION_FLAG for code in codes]

CONDITIONS = {
    "condition_id": f"'c' || {_LINE_ID}",
    "patient_id": _text("p", "o_custkey"),
    "encounter_id": _text("e", "l_orderkey"),
    "code_system": "'http://snomed.info/sct'",
    "code": f"CASE WHEN l_suppkey % 26 < {len(_FLAG_CODES)} THEN {_pick('l_suppkey % 26', _FLAG_CODES)} "
    "WHEN l_suppkey % 26 = 25 THEN NULL ELSE " + _text("X", "l_partkey % 50") + " END",
    "display": _pick(
        "l_partkey % 9",
        [
            "Diabetes mellitus type 2 (disorder)",
            "Stress (FINDING)",
            "Medication review due (situation)",
            "Dressing change (procedure)",
            "Fall (event)",
            "Sprain (Morphologic Abnormality)",
            "Refugee (person)",
            "Trailing blank (disorder) ",
            None,
        ],
    ),
    "clinical_status": _pick("l_linenumber", ["x", "active", "Recurrence", "resolved", None, "RELAPSE", "inactive"]),
    "verification_status": "'confirmed'",
    "onset_date": "l_shipdate",
    "abatement_date": "CASE WHEN l_partkey % 4 = 0 THEN l_shipdate + 30 * interval '1' day END",
    "recorded_date": "l_shipdate + 1 * interval '1' day",
    "load_timestamp": "l_shipdate",
    "load_batch_id": _LINE_BATCH,
}

MEDICATIONS = {
    "medication_request_id": f"'m' || {_LINE_ID}",
    "patient_id": _text("p", "o_custkey"),
    "encounter_id": _text("e", "l_orderkey"),
    "status": "CASE WHEN l_suppkey % 41 = 0 THEN NULL WHEN l_suppkey % 43 = 0 THEN 'stopped' "
    "WHEN l_linestatus = 'O' THEN 'active' ELSE 'completed' END",
    "intent": "'order'",
    "code_system": "CASE WHEN l_suppkey % 5 <> 0 THEN 'http://www.nlm.nih.gov/research/umls/rxnorm' END",
    "medication_code": _text("", "l_partkey % 1000"),
    "medication_display": _pick(
        "l_partkey % 20",
        [
            "metformin hydrochloride 500 MG Oral Tablet",
            "Insulin Lispro 100 UNT/ML",
            "lisinopril 10 MG Oral Tablet",
            "Losartan Potassium 50 MG",
            "amLODIPine 2.5 MG Oral Tablet",
            "hydrochlorothiazide 12.5 MG / lisinopril 10 MG",
            "Hydrochlorothiazide 25 MG",
            "furosemide 40 MG Oral Tablet",
            "carvedilol 25 MG Oral Tablet",
            "Simvastatin 20 MG / metformin 500 MG",
            "atorvastatin 80 MG",
            "NDA020503 200 ACTUAT albuterol 0.09 MG/ACTUAT",
            "fluticasone propionate 0.25 MG/ACTUAT",
            "Acetaminophen 300 MG / HYDROcodone Bitartrate 5 MG",
            "Ibuprofen 200 MG Oral Tablet",
            "oxyCODONE Hydrochloride 5 MG",
            "fentanyl 0.05 MG/HR patch",
            "Amoxicillin 250 MG Oral Capsule",
            None,
            "Etonogestrel 68 MG Drug Implant",
        ],
    ),
    "authored_on": "l_shipdate",
    "dosage_text": "CASE WHEN l_quantity > 25 THEN 'twice daily' END",
    "load_timestamp": "l_shipdate",
    "load_batch_id": _LINE_BATCH,
}

_EVENT_CODES = [
    "9279-1", "8302-2", "29463-7", "39156-5", "33914-3", "2160-0",
    "2093-3", "2085-9", "2089-1", "13457-7", "72166-2", "72514-3", "8462-4",
]

OBSERVATIONS = {
    "observation_id": _text("o", "event_id"),
    "parent_observation_id": "CASE WHEN event_id % 29 = 0 THEN " + _text("parent", "event_id") + " END",
    "patient_id": _text("p", "user_id"),
    "encounter_id": _text("e", "event_id"),
    "status": "'final'",
    "category": _pick("event_id % 5", ["social-history", "survey", "laboratory", "vital-signs", None]),
    "loinc_code": "CASE WHEN event_id % 13 = 0 THEN NULL "
    f"WHEN event_id % 13 = 1 THEN {_pick('cast(floor(event_id / 13) as bigint) % 13', _EVENT_CODES)} "
    "WHEN event_type = 'signup' THEN '4548-4' WHEN event_type = 'error' THEN '8480-6' "
    "WHEN event_type = 'click' THEN '8462-4' WHEN event_type = 'view' THEN '8867-4' ELSE '2339-0' END",
    "loinc_display": "event_type",
    "value_numeric": "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 9 "
    "WHEN event_type = 'purchase' THEN value * 3 WHEN batch = 2 THEN value + 1 ELSE value END",
    "value_text": "CASE WHEN event_id % 19 = 0 THEN 'text' END",
    "value_code": "CASE WHEN event_id % 23 = 0 THEN 'LA1' END",
    "value_code_system": "CASE WHEN event_id % 23 = 0 THEN 'http://loinc.org' END",
    "unit": _pick("event_id % 3", ["%", "mmol/mol", None]),
    "effective_date": "ts",
    "issued_date": "ts",
    "load_timestamp": "CASE WHEN batch = 2 THEN ts + 1 * interval '1' day ELSE ts END",
    "load_batch_id": _text("b", "batch"),
}

# Record set -> source tables, condition for a second load batch, columns.
SHAPES: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "patients": ("customer", "c_custkey % 5 = 0", PATIENTS),
    "encounters": ("orders", "o_orderkey % 6 = 0", ENCOUNTERS),
    "conditions": ("lineitem JOIN orders ON l_orderkey = o_orderkey", None, CONDITIONS),
    "medication_requests": ("lineitem JOIN orders ON l_orderkey = o_orderkey", None, MEDICATIONS),
    "observations": ("events", "event_id % 10 = 0", OBSERVATIONS),
}


def bronze(spark: SparkSession, sf_dir: str, record: str) -> DataFrame:
    source, reloaded, columns = SHAPES[record]
    if " JOIN " in source:
        lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
        rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    else:
        rows = table(spark, sf_dir, source)
    if reloaded:
        batches = f"CASE WHEN {reloaded} THEN array(1, 2) ELSE array(1) END"
        rows = rows.select("*", F.explode(F.expr(batches)).alias("batch"))
    types = {f.name: f.dataType for f in schemas.bronze_schema(record).fields}
    return rows.select(
        *[
            F.expr(expression.replace("{TS}", "timestamp_ntz")).cast(types[name]).alias(name)
            for name, expression in columns.items()
        ]
    )


def all_bronze(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {record: bronze(spark, sf_dir, record) for record in SHAPES}


def bronze_sql(record: str) -> str:
    source, reloaded, columns = SHAPES[record]
    if reloaded:
        batches = f"CASE WHEN {reloaded} THEN [1, 2] ELSE [1] END"
        source = f"(SELECT *, unnest({batches}) AS batch FROM {source})"
    selected = ",\n  ".join(
        f"{expression.replace('{TS}', 'timestamp')} AS {name}" for name, expression in columns.items()
    )
    return f"SELECT {selected} FROM {source}"
