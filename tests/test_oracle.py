"""Registered queries against DuckDB on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal_to_oracle(spark, con, name):
    assert difference(entry.queries()[name](spark, FOLDER), con, ORACLE[name]) is None


def test_every_oracle_has_a_query(spark):
    assert set(ORACLE) <= set(entry.queries())
    assert entry.entry(spark).count() == 15
