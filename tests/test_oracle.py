"""Every query against its SQL twin on the smallest tables; those without one must run."""

import pytest

import oracle
from orderlake.plans import catalog

ROWS_ONLY = sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, name):
    oracle.assert_same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, oracle.DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1500
    assert set(e.oracle_sql()) <= set(e.queries())
