"""The registered queries of this subpackage against their SQL."""

import parity
import pytest

import __spark_entry__ as entry
from quillframe.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = parity.duck(FOLDER)
    ok, note = parity.compare(spark, con, FOLDER, name, QUERIES[name], ORACLES[name])
    assert ok, note
