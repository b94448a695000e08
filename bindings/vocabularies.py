"""Rule tables with as many rules as the driver's tables have rows (R02, R03, R06, R07, R09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings.registry import Data, register
from fhirlake.operators import vocabulary

# Both sides state rules and texts in the same SQL. Several rules have one key, keys contain each other, and case differs.
_CODES = "SELECT cast(p_partkey - p_partkey % 3 AS string) AS code, concat('label ', p_partkey % 50) AS label, p_partkey % 4 AS priority FROM part"
_SUFFIXES = (
    "SELECT CASE WHEN p_partkey % 40 = 0 THEN concat('(Kind', p_partkey % 7, ')') WHEN p_partkey % 2 = 0 THEN cast(p_partkey AS string) "
    "ELSE concat('item ', p_partkey) END AS suffix, concat('label ', p_partkey % 50) AS label, p_partkey % 5 AS priority FROM part"
)
_WORDS = (
    "SELECT CASE WHEN p_partkey % 60 = 0 THEN cast(p_partkey % 10 AS string) WHEN p_partkey % 60 = 1 THEN concat('g', p_partkey % 10) "
    "ELSE concat('dRUG ', p_partkey) END AS word, concat('label ', p_partkey % 50) AS label, p_partkey % 9 AS priority FROM part"
)
_ENDINGS = (
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN concat('Thing (kIND', o_custkey % 9, ')') "
    "ELSE concat('some Item ', o_custkey) END AS display FROM orders"
)
_TEXTS = (
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'none of it' "
    "ELSE concat('a Drug ', o_custkey, ' mg') END AS display FROM orders"
)


def _sql(d: Data, statement: str, table: str) -> DataFrame:
    return d.spark.sql(statement.replace(f"FROM {table}", "FROM {rows}"), rows=d.table(table))


def _oracle(statement: str) -> str:
    return statement.replace("AS string)", "AS varchar)")


def _winner(rows: str, key: str, text: str, rules: str, fits: str, default: str) -> str:
    return (
        f"WITH t AS ({_oracle(rows)}), r AS ({_oracle(rules)}), m AS (SELECT t.*, label, row_number() OVER (PARTITION BY {key} "
        f"ORDER BY priority NULLS LAST, label) AS place FROM t LEFT JOIN r ON {fits}) "
        f"SELECT {key}, {text}, coalesce(label, '{default}') AS label FROM m WHERE place = 1"
    )


_LINES = "SELECT concat(l_orderkey, '-', l_linenumber) AS line, cast(l_partkey AS string) AS code FROM lineitem"
register(
    "R03_code_table",
    lambda d: vocabulary.by_code(_sql(d, _LINES, "lineitem"), "code", _sql(d, _CODES, "part"), "label", "other"),
    f"WITH t AS ({_oracle(_LINES)}), w AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY priority, label) AS place "
    f"FROM ({_oracle(_CODES)})) SELECT line, t.code, coalesce(label, 'other') AS label FROM t LEFT JOIN w ON t.code = w.code AND place = 1",
)
register(
    "R02_suffix_table",
    lambda d: vocabulary.by_suffix(_sql(d, _ENDINGS, "orders"), "display", _sql(d, _SUFFIXES, "part"), "label", "other"),
    _winner(_ENDINGS, "o_orderkey", "display", _SUFFIXES, "ends_with(lower(display), lower(suffix))", "other"),
)
register(
    "R06_word_table",
    lambda d: vocabulary.by_substring(_sql(d, _TEXTS, "orders"), "display", _sql(d, _WORDS, "part"), "label", "other"),
    _winner(_TEXTS, "o_orderkey", "display", _WORDS, "contains(lower(display), lower(word))", "other"),
)


def _two_tables(d: Data) -> DataFrame:
    """By code; where no rule has it, by the ending."""
    rows = _sql(d, _ENDINGS, "orders").withColumn("code", F.col("o_orderkey").cast("string"))
    codes, endings = _sql(d, _CODES, "part"), _sql(d, _SUFFIXES, "part")
    found = vocabulary.first_of(
        rows,
        "label",
        lambda df, name: vocabulary.by_code(df, "code", codes, name),
        lambda df, name: vocabulary.by_suffix(df, "display", endings, name),
        default="other",
    )
    return found.select("o_orderkey", "label")


register(
    "R09_two_tables",
    _two_tables,
    f"WITH t AS ({_oracle(_ENDINGS)}), c AS ({_oracle(_CODES)}), s AS ({_oracle(_SUFFIXES)}), m AS ("
    "SELECT o_orderkey, 1 AS step, priority, label FROM t JOIN c ON code = cast(o_orderkey AS varchar) "
    "UNION ALL SELECT o_orderkey, 2, priority, label FROM t JOIN s ON ends_with(lower(display), lower(suffix))), "
    "w AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY step, priority, label) AS place FROM m) "
    "SELECT t.o_orderkey, coalesce(label, 'other') AS label FROM t LEFT JOIN w ON w.o_orderkey = t.o_orderkey AND place = 1",
)
