"""Panels from the star-schema and event tables: one row per entity and date with open, high, low, close, vol, cap, ret."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import by_entity, half_away, safe_div


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_returns(panel: DataFrame) -> DataFrame:
    """Adds ret, the close-to-close return over an entity's own sessions."""
    return panel.withColumn("ret", safe_div("close", F.lag("close").over(by_entity())) - 1)


def ev_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and day."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("date"), "ts", "value")
    g = e.groupBy("entity", "date").agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
        F.count("*").cast("double").alias("vol"), F.round(F.sum("value"), 6).alias("cap"))
    return with_returns(g)


def su_daily(spark: SparkSession, sf_dir: str, entity: str = "l_suppkey") -> DataFrame:
    """Line items by supplier (or part) and shipping day; sums are exact, so no order matters.

    Lines are dealt by entity once, which serves the days' sums and all windows after them: days are nearly as many as lines,
    so sums before the shuffle would save nothing, and a second shuffle for the windows would be as large.
    """
    li = table(spark, sf_dir, "lineitem").select(F.col(entity).alias("entity"), F.to_date("l_shipdate").alias("date"), "l_quantity", "l_extendedprice").repartition("entity")
    g = li.withColumn("price", F.col("l_extendedprice") / F.col("l_quantity")).groupBy("entity", "date").agg(
        half_away(F.avg("price"), 6).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("vol"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("cap"))
    return with_returns(g.withColumn("close", safe_div("cap", "vol")))


def period_panel(daily: DataFrame, unit: str) -> DataFrame:
    """Each entity's last own row in every week, month or quarter, with returns between these rows."""
    last = daily.withColumn("period", F.to_date(F.date_trunc(unit, "date"))).groupBy("entity", "period").agg(
        *(F.max_by(c, "date").alias(c) for c in ("open", "high", "low", "close", "vol", "cap")), F.max("date").alias("date"))
    return with_returns(last.select("entity", "date", "period", "open", "high", "low", "close", "vol", "cap"))
