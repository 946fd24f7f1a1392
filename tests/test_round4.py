"""Queries beside SQL on cuttings of sf0.1 that hold what smaller tables lack: closes of zero, averages at a half."""

import os

import duckdb
import pytest
from oracle import TABLES, differing

from tessera.plans import registry

SF = "/root/testdata/sf0.1"


@pytest.fixture
def cut(tmp_path):
    """A copy of sf0.1 with some rows of one table only."""

    def make(name, where):
        for t in TABLES:
            if t != name:
                os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        con.execute(f"COPY (SELECT * FROM '{SF}/{name}.parquet' WHERE {where}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return make


def same(spark, sf, name):
    assert differing(spark, sf, registry.QUERIES[name], registry.ORACLE_SQL[name]) == []


#: Users with a day that closes at zero, and some others.
ZERO = f"user_id < 40 OR user_id IN (SELECT user_id FROM '{SF}/events.parquet' WHERE value = 0)"


def test_overview_with_a_close_of_zero(spark, cut):
    same(spark, cut("events", ZERO), "overview")


def test_transfer_compare_with_a_close_of_zero(spark, cut):
    same(spark, cut("events", ZERO), "transfer_compare")


#: Suppliers with a day whose mean price is a half at six digits.
HALVES = "l_suppkey IN (457, 480, 661)"


def test_chart_bars_with_an_open_at_a_half(spark, cut):
    same(spark, cut("lineitem", HALVES), "chart_bars")


def test_price_rows_with_an_open_at_a_half(spark, cut):
    same(spark, cut("lineitem", HALVES), "price_rows")


#: Suppliers among whom a month's closes over opens are ties, or not, by how an open at a half is rounded.
TIED = "l_suppkey < 120 OR l_suppkey IN (522, 817, 581, 271, 491, 456, 222, 754)"


def test_rule_high_low_with_an_open_at_a_half(spark, cut):
    same(spark, cut("lineitem", TIED), "rule_high_low")


def test_rule_sharpe_summary_with_an_open_at_a_half(spark, cut):
    same(spark, cut("lineitem", TIED), "rule_sharpe_summary")


def test_daily_bars_are_shuffled_once(spark):
    from pyspark.sql import functions as F

    from tessera.functions.expr import compounded
    from tessera.sources.panels import su_daily

    d = su_daily(spark, SF).withColumn("ahead", compounded("ret", 1, 5)).groupBy("entity").agg(F.max("ahead"))
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
