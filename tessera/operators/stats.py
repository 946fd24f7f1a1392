"""Inference: Newey-West t statistics, stars, likelihoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, safe_div

#: Two-sided critical values of the normal distribution (fixed values).
STARS = ((2.576, "***"), (1.960, "**"), (1.645, "*"))


def auto_lag(n: Column) -> Column:
    """max(1, floor(4 (n / 100)^(2/9))), at most n - 1; 0 below two observations."""
    lag = F.least(F.greatest(F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))), F.lit(1)), n - 1)
    return F.when(n < 2, 0).otherwise(lag).cast("int")


def mean_t(series: DataFrame, c: str, by: list[str], lags: int | str | None = "auto") -> DataFrame:
    """Mean, Newey-West standard error (Bartlett weights) and t per key; lags 0 or None: the plain standard error.

    ``series`` is ordered by date inside each key. NULL below two observations or where the error is not positive.
    """
    d = series.where(F.col(c).isNotNull()).select(*by, "date", F.col(c).cast("double").alias("__x"))
    whole, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("date")
    d = d.withColumn("__n", F.count("*").over(whole)).withColumn("__e", F.col("__x") - F.avg("__x").over(whole))
    if isinstance(lags, str) and lags.isdigit():
        lags = int(lags)
    lag = auto_lag(F.col("__n")) if lags == "auto" else F.least(F.lit(int(lags or 0)), F.col("__n") - 1).cast("int")
    d = d.withColumn("__lag", lag)
    # each residual with those of the next lags, as an array: the lag grows as the power 2/9 of a series' length, and a
    # million of observations have one of 32; 400 are enough for 10^11
    ahead = F.collect_list("__e").over(w.rowsBetween(0, 400 if lags == "auto" else max(1, int(lags or 0))))
    ahead = F.slice(ahead, 1, F.col("__lag") + 1)
    d = d.withColumn("__ahead", ahead)
    weight = lambda i: F.when(i == 0, F.lit(1.0)).otherwise(2 * (1 - i / (F.col("__lag") + 1)))
    term = F.aggregate(F.sequence(F.lit(0), F.least(F.col("__lag"), F.size("__ahead") - 1)), F.lit(0.0), lambda acc, i: acc + weight(i) * F.col("__e") * F.get("__ahead", i))
    g = d.withColumn("__t", term).groupBy(*by).agg(F.count("*").alias("n"), F.first("__lag").alias("lag"), F.avg("__x").alias("mean"), F.sum("__t").alias("__s"), F.stddev_samp("__x").alias("__sd"))
    se = F.when(F.col("lag") == 0, F.col("__sd") / F.sqrt("n")).otherwise(F.sqrt(F.greatest(F.col("__s"), F.lit(0.0)) / F.col("n") / F.col("n")))
    g = g.withColumn("se", F.when((F.col("n") >= 2) & (se > 0), se))
    return g.select(*by, "n", "lag", "mean", "se", safe_div("mean", "se").alias("t"))


def stars(t: Column) -> Column:
    out = F.when(t.isNull(), "")
    for level, mark in STARS:
        out = out.when(F.abs(t) >= level, mark)
    return out.otherwise("")


def cell(value: Column, t: Column) -> Column:
    """``5.85***``: two digits and stars."""
    return F.concat(F.format_string("%.2f", value), stars(t))


def log_likelihood(y: str, p: str, by: list[str], rows: DataFrame) -> DataFrame:
    """Bernoulli log likelihood, probabilities kept 1e-12 away from 0 and 1."""
    q = clip(F.col(p), 1e-12, 1 - 1e-12)
    return rows.groupBy(*by).agg(F.sum(F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("ll"), F.count("*").alias("n"))


def mcfadden(ll: Column, ll0: Column) -> Column:
    return 100 * (1 - safe_div(ll, ll0))
