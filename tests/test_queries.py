"""Every bound query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as bound
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(bound.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, name, FOLDER) == ""


def test_oracles_belong_to_queries():
    assert set(bound.oracle_sql()) <= set(bound.queries())


def test_entry(spark):
    rows = bound.entry(spark).collect()
    assert len(rows) == 18 and {r["year"] for r in rows} == {1999, 2000, 2001}
