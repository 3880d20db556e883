"""Every registered query against its SQL, on the smallest tables."""

import os

import parity
import pytest

import __spark_entry__ as entry
from quillframe.plans.catalogue import QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return parity.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    ok, note = parity.compare(spark, con, SF_DIR, name, entry.queries()[name], sql)
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"segment", "orders", "average_total"} and df.count() == 5


def test_every_query_has_sql_to_compare_with():
    assert set(QUERIES) <= set(entry.oracle_sql())
