"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        problem, rows, _ = compare(df, duck.sql(SQL[name]))
        assert not problem
    else:
        rows = df.count()
    assert rows > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_sql_names_are_registered():
    assert set(SQL) <= set(QUERIES)
