"""Every query with SQL equals it on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import oracles
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_equals_sql(spark, con, name):
    rows = entry.queries()[name](spark, SF).toPandas()
    assert len(rows) > 0
    assert difference(rows, con.execute(oracles.oracle_sql()[name]).df()) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
