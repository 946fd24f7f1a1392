"""Calendars: distinct dates, period ends, windows by ordinal, neighbours.

The calendar is small (one row per trading day); ordered windows over all of it run on that frame only, never on a panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def market_calendar(panel: DataFrame, date: str = "date") -> DataFrame:
    """Sorted distinct dates with their ordinal from 1."""
    d = panel.select(F.to_date(date).alias("date")).where("date is not null").distinct()
    return d.withColumn("ord", F.row_number().over(Window.orderBy("date")).cast("long"))


def period_ends(calendar: DataFrame, unit: str, lo: str | None = None, hi: str | None = None, clip_first: bool = False) -> DataFrame:
    """The last trading date of each week (Monday to Sunday), month or quarter, clipped to [lo, hi].

    Dates are clipped after they are grouped, unless ``clip_first``.
    """
    within = lambda d: d.where(F.col("date").between(F.lit(lo or "0001-01-01").cast("date"), F.lit(hi or "9999-12-31").cast("date")))
    d = within(calendar) if clip_first else calendar
    ends = d.groupBy(F.to_date(F.date_trunc(unit, "date")).alias("period")).agg(F.max("date").alias("date"))
    return within(ends).select("period", "date")


def own_last(unit: str) -> Column:
    """Whether a row is the last of its entity's in its week, month or quarter."""
    period = F.date_trunc(unit, "date")
    after = F.lead(period).over(Window.partitionBy("entity").orderBy("date"))
    return F.col("entity").isNotNull() & F.col("date").isNotNull() & F.coalesce(after != period, F.lit(True))


def window_dates(calendar: DataFrame, as_of: DataFrame, n: int, forward: bool = False, strict: bool = True) -> DataFrame:
    """For each as-of date the ``n`` trading dates that end with it, or with ``forward`` the ``n`` that follow it.

    An as-of date that is no trading day, or whose window is not whole, raises; with ``strict`` off it is left out.
    """
    steps = F.sequence(F.lit(1), F.lit(n)) if forward else F.sequence(F.lit(1 - n), F.lit(0))
    ends = calendar.agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    a = as_of.select(F.col("date").alias("as_of")).join(calendar, F.col("as_of") == F.col("date"), "left").crossJoin(F.broadcast(ends))
    first, last = (F.col("ord") + 1, F.col("ord") + n) if forward else (F.col("ord") - (n - 1), F.col("ord"))
    whole = F.coalesce((first >= F.col("lo")) & (last <= F.col("hi")), F.lit(False))
    if strict:
        why = F.when(F.col("ord").isNull(), F.lit("no trading day: ")).otherwise(F.lit(f"fewer than {n} trading days about "))
        a = a.withColumn("ord", F.when(whole, F.col("ord")).otherwise(F.raise_error(F.concat(why, F.col("as_of").cast("string"))).cast("long")))
    else:
        a = a.where(whole)
    wanted = a.select("as_of", F.explode(F.transform(steps, lambda s: F.struct(s.alias("step"), (F.col("ord") + s).alias("at")))).alias("w")).select("as_of", "w.step", F.col("w.at").alias("ord"))
    return wanted.join(calendar, "ord").select("as_of", "step", "date")


def neighbours(dates: DataFrame) -> DataFrame:
    """Each date with the one before and the one after it."""
    w = Window.orderBy("date")
    return dates.select("date").distinct().select("date", F.lag("date").over(w).alias("previous"), F.lead("date").over(w).alias("following"))


def with_date_rank(panel: DataFrame) -> DataFrame:
    """The panel with the dense rank of its dates, from a join with the calendar."""
    return panel.join(market_calendar(panel).withColumnRenamed("ord", "date_rank"), "date")


def with_year(panel: DataFrame) -> DataFrame:
    return panel.withColumn("year", F.year("date"))


def between_dates(panel: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    if lo:
        panel = panel.where(F.col("date") >= F.lit(lo).cast("date"))
    return panel.where(F.col("date") <= F.lit(hi).cast("date")) if hi else panel


def weekly_summary(panel: DataFrame) -> DataFrame:
    """Compounded return and annualised volatility by entity and week."""
    week = F.to_date(F.date_trunc("week", "date")).alias("week")
    r = F.when(F.col("ret") > -1, F.log1p("ret"))
    return panel.groupBy("entity", week).agg(F.expm1(F.sum(r)).alias("week_ret"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("ann_vol"), F.count("ret").alias("n_days"))
