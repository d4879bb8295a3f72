"""Every query with SQL equals it on the smallest tables."""

import pytest

from checks.compare import connect, difference
from shelfmark.llm import queries as llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_sql(spark, name):
    rows = llm.queries()[name](spark, SF).toPandas()
    assert len(rows) > 0
    assert difference(rows, connect(SF).execute(llm.oracle_sql()[name]).df()) == ""


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in llm.queries())
    assert numbers == list(range(1, 14))
