"""Every registered query with SQL agrees with the other engine, value by value."""

import pytest

import __spark_entry__ as entry
from parity import connect, difference

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def other(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, folder, other, name):
    assert difference(entry.queries()[name](spark, folder), other, SQL[name]) is None


def test_flagship(spark):
    assert entry.entry(spark).count() == 20
