"""Every registered query against its checking statement on the smallest data."""

import pytest

import __spark_entry__ as entries
from tests.compare import connection, difference

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


NAMES = sorted(entries.QUERIES)


def test_every_query_is_checked():
    assert set(NAMES) == set(entries.CHECKS)


def test_entry(spark):
    assert entries.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    result = difference(entries.queries()[name](spark, DATA), con, entries.oracle_sql()[name])
    assert result == "", result
