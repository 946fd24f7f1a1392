"""Point-in-time joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .calendar import market_calendar


def merge_on_keys(left: DataFrame, right: DataFrame, start: str | None = None) -> DataFrame:
    """Inner join by entity and date, from ``start``."""
    out = left.join(right, ["entity", "date"])
    return out.where(F.col("date") >= F.lit(start).cast("date")) if start else out


def lagged_return(signals: DataFrame, returns: DataFrame, lag: int, ret: str = "ret") -> DataFrame:
    """The return ``lag`` market dates after each signal's date.

    The offset counts the signals' dates, not an entity's rows: an entity that is absent there drops out.
    """
    cal = market_calendar(signals)
    ahead = cal.select(F.col("date").alias("ret_date"), (F.col("ord") - lag).alias("ord")).join(cal, "ord").select("date", "ret_date")
    r = returns.select("entity", F.col("date").alias("ret_date"), F.col(ret).alias(ret))
    return signals.drop(ret).join(ahead, "date").join(r, ["entity", "ret_date"]).drop("ret_date")


def eval_horizon(panel: DataFrame, h: int, ret: str = "ret") -> DataFrame:
    """The panel with the return of the h-th holding period (1: its own)."""
    return panel if h == 1 else lagged_return(panel, panel.select("entity", "date", ret), h - 1, ret)


def at_dates(as_of: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals at exactly the as-of rows (entity, date); missing ones stay NULL, nothing is filled."""
    return as_of.join(signals, ["entity", "date"], "left")


def as_of_join(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Each left row with the latest right value of its entity up to its date: one shuffle, one sort, no self-join."""
    columns = left.columns
    r = right.select("entity", "date", F.col(value).alias("__v"))
    a = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__left", F.lit(1))
    b = r.select("entity", "date", "__v", F.lit(0).alias("__left"))
    w = Window.partitionBy("entity").orderBy("date", "__left").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("__v", True).over(w))
    return both.where("__left = 1").select(*columns, value)


def ensemble(members: list[DataFrame], value: str = "p_up") -> DataFrame:
    """Mean over members of keys that all of them have."""
    one = reduce(lambda a, b: a.unionByName(b), [m.select("entity", "date", F.col(value).alias("__v")) for m in members])
    return one.groupBy("entity", "date").agg(F.avg("__v").alias(value), F.count("*").alias("__n")).where(F.col("__n") == len(members)).drop("__n")


def with_market(panel: DataFrame, market: DataFrame) -> DataFrame:
    """A date-level table onto the panel."""
    return panel.join(market, "date", "left")


def range_join(points: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = (), at: str = "date", since: str = "since", until: str = "until", days: int = 32) -> DataFrame:
    """Rows of ``points`` with the intervals (both ends included, a missing end is open) that hold their date and share
    their keys: the columns of both. A point that lies in several intervals has a row for each.

    Time is cut into bins of ``days``; an interval stands in each bin that it meets and a point in its own, so bins and
    keys are what is joined on, and the ends are tested inside. Open ends reach to the first and the last point.
    """
    bin_ = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    edges = points.agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    spans = intervals.crossJoin(F.broadcast(edges)).withColumns({"__since": F.greatest(F.coalesce(since, "__first"), F.col("__first")), "__until": F.least(F.coalesce(until, "__last"), F.col("__last"))})
    spans = spans.where("__since <= __until").withColumn("__bin", F.explode(F.sequence(bin_(F.col("__since")), bin_(F.col("__until"))))).drop("__first", "__last")
    joined = points.withColumn("__bin", bin_(F.col(at))).join(spans, [*keys, "__bin"])
    return joined.where(F.col(at).between(F.col("__since"), F.col("__until"))).drop("__bin", "__since", "__until")
