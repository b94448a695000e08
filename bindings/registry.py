"""Registered queries: a Spark callable per operator and its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import documents, oracle, shapes
from fhirlake.plans.silver import MODELS, silver_patients


@dataclass(frozen=True)
class Data:
    """The driver's tables of one scale factor, and what is derived from them."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return shapes.table(self.spark, self.sf_dir, name)

    def bronze(self, record: str) -> DataFrame:
        return shapes.bronze(self.spark, self.sf_dir, record)

    def silver(self, name: str) -> DataFrame:
        record, build = MODELS[f"silver_{name}"]
        rows = self.bronze(record)
        return silver_patients(rows, shapes.AS_OF) if name == "patients" else build(rows)

    def some_patients(self) -> DataFrame:
        """Every tenth patient left out, so that children have missing parents."""
        number = F.substr("patient_id", F.lit(2)).cast("long")
        return self.silver("patients").filter(number % 10 != 0)

    def bundles(self, *sources: str) -> DataFrame:
        return documents.bundles(self.spark, self.sf_dir, *sources)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PLAIN: dict[str, str] = {}  # as stated, without the relations that `oracle.statement` adds
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Data], DataFrame], sql: str | None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} registered twice")
    QUERIES[name] = lambda spark, sf_dir: build(Data(spark, sf_dir))
    if sql is not None:
        PLAIN[name] = sql
        ORACLES[name] = oracle.statement(sql)
