"""The driver's three functions and every registered query against its SQL."""

from __future__ import annotations

import os

import pytest
from oracle import connect, differences

import __spark_entry__ as entry_module

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry_module.oracle_sql()
QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 200


def test_entry_gives_rows(spark):
    assert entry_module.entry(spark).count() == 15


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_sql(spark, duck, key):
    got = QUERIES[key](spark, SF).toPandas()
    want = duck.execute(SQL[key]).df()
    assert not differences(got, want)
