"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(PATH)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, PATH, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note
