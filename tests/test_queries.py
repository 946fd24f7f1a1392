"""Every query with an SQL twin against DuckDB, and every other one for a result."""

import os

import pytest
from oracle import differing

from tessera.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert differing(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name]) == []


#: Queries without an SQL twin that need more names on a date than the smallest tables have.
MORE = {"trend_score_backtest", "fama_macbeth_logit"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.01" if name in MORE else SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
