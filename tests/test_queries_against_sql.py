"""Every query that has SQL, on the small tables, as multisets of rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert compare.compare(spark, con, name, FOLDER)[0] == "ok"


def test_every_sql_has_a_query_and_names_are_whole():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 2, 4, 5)} <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
