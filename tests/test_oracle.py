import pathlib

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from mailsift.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    problem = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert problem is None or problem == "equal but empty"


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"mailbox", "disposition", "messages", "clean_chars"}
