"""Every registered query against its SQL on the given tables."""

import pytest
from compare import connect, differences

from lectern.plans.registry import all_queries

QUERIES = all_queries()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_rows_as_sql(name, spark, data, con):
    query = QUERIES[name]
    assert differences(query.run(spark, data), con, query.sql) is None


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs_without_sql(name, spark, data):
    assert QUERIES[name].run(spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
