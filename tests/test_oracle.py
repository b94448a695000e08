"""Every registered query next to its DuckDB statement, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from bindings import registry
from tools import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_query_has_a_statement():
    assert set(registry.ORACLES) == set(registry.QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() == 1


# At this size these have no offending or matching row on either side.
EMPTY_HERE = {"both empty"}


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    assert compare.differences(spark, con, SF, name) in {None} | EMPTY_HERE
