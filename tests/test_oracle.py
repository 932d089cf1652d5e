"""Every query with SQL against DuckDB on the same tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return connect(DATA)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(name, spark, duck):
    assert compare(entry.queries()[name](spark, DATA), entry.oracle_sql()[name], duck) == ""


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
