from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))


@pytest.fixture
def table(spark):
    """A DataFrame from rows, with a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
