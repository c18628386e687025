import oracle
import pytest

import __spark_entry__ as entry
from gritstone.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, con, name):
    rows, sql = catalog.queries()[name](spark, SMALL), catalog.oracle_sql().get(name)
    if sql is None:  # held against brute force in test_flow
        assert rows.count() > 0
    else:
        oracle.same(rows, con, sql)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
