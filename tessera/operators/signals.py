"""Time-series operators over an entity's own sessions: labels, trend signals, risk and liquidity characteristics.

All of an operator's window expressions share one partitioning and one sort, so a panel is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import by_entity, compounded, finite, log1p_safe, prefixed, rolling, safe_div, window_sum, with_extremes, without_prefixes
from ..spec import ALIASES, HORIZONS

#: Lengths of the moving averages (fixed values).
MA_LENGTHS = (3, 5, 10, 20, 50, 100, 200, 400)
YEAR, MONTH, WEEK = 252, 21, 5
EWMA_SPAN = 60


def forward_returns(panel: DataFrame, horizons=HORIZONS, ret: str = "ret") -> DataFrame:
    """Compounded returns over the next h own sessions, NULL unless all h returns are there."""
    return panel.withColumns({f"ret_{h}d": compounded(ret, 1, h) for h in horizons})


def label(ret: Column | str) -> Column:
    """1 if a return is positive, 0 if not, 2 if it is missing."""
    ret = F.col(ret) if isinstance(ret, str) else ret
    return F.when(ret.isNull(), 2).when(ret > 0, 1).otherwise(0)


def t_statistic(ret: Column, vol: Column) -> Column:
    """Return over volatility; 0 where volatility is missing or zero, NULL where only the return is."""
    return F.when(vol.isNotNull() & (vol != 0), ret / vol).otherwise(F.lit(0.0))


def ewma_vol(panel: DataFrame, span: int = EWMA_SPAN, ret: str = "ret") -> DataFrame:
    """Exponentially weighted volatility, bias-corrected; NULL until ``span`` returns are there, gaps keep decaying.

    Weighted sums are prefix sums with weights that grow by 1/decay a row, rebased in blocks of rows so that they stay
    within double range on histories of any length: a block carries what earlier blocks left, decayed.
    """
    decay = 1 - 2 / (span + 1)
    block = 2000
    w = by_entity()
    x = finite(ret)
    d = panel.withColumn("__i", F.row_number().over(w) - 1).withColumn("__x", x)
    d = d.withColumn("__b", F.floor(F.col("__i") / block)).withColumn("__k", F.col("__i") % block)
    weight = F.when(F.col("__x").isNotNull(), F.pow(F.lit(1 / decay), F.col("__k").cast("double")))
    parts = {"s0": weight, "q": weight * weight, "s1": weight * F.col("__x"), "s2": weight * F.col("__x") * F.col("__x")}
    # per block and entity: the sums of that block in units of its first row
    sums = d.groupBy("entity", "__b").agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(f"__{n}") for n, v in parts.items()), F.count("__x").alias("__n"))
    before = Window.partitionBy("entity").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("entity", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n_before"), F.collect_list(F.struct("__b", "__s0", "__q", "__s1", "__s2")).over(before).alias("__past"))

    def carry(name: str, power: int) -> Column:
        # a block that ended m blocks ago has weights smaller by decay^(block * m * power)
        return F.aggregate("__past", F.lit(0.0), lambda acc, p: acc + p[f"__{name}"] * F.pow(F.lit(decay), (F.col("__b") - p["__b"]).cast("double") * block * power))

    carried = carried.select("entity", "__b", "__n_before", *(carry(n, 2 if n == "q" else 1).alias(f"__c_{n}") for n in parts))
    d = d.join(carried, ["entity", "__b"])
    inside = Window.partitionBy("entity", "__b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    s = {n: F.col(f"__c_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0.0)) for n, v in parts.items()}
    count = F.col("__n_before") + F.count("__x").over(inside)
    d = d.withColumns({f"__{n}": v for n, v in s.items()} | {"__count": count})
    mean = safe_div("__s1", "__s0")
    var = (safe_div("__s2", "__s0") - mean * mean) * safe_div(F.col("__s0") * F.col("__s0"), F.col("__s0") * F.col("__s0") - F.col("__q"))
    vol = F.when(F.col("__count") >= span, F.sqrt(F.greatest(var, F.lit(0.0))))
    return d.withColumn("ewma_vol", vol).select(*panel.columns, "ewma_vol")


def label_panel(panel: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Forward returns with labels and t statistics, volatility, caps and the named horizons."""
    d = forward_returns(ewma_vol(panel), horizons)
    vol = F.col("ewma_vol")
    extra = {f"ret_{h}d_label": label(f"ret_{h}d") for h in horizons} | {f"ret_{h}d_tstat": t_statistic(F.col(f"ret_{h}d"), vol) for h in horizons}
    extra |= {f"ret_{n}": F.col(f"ret_{h}d") for n, h in ALIASES.items() if h in horizons} | {"ret_label": label("ret"), "ret_tstat": t_statistic(F.col("ret"), vol)}
    return d.withColumns(extra)


def momentum() -> Column:
    """Compounded return over 252 sessions up to 21 sessions ago; needs ``log_ret`` among the prefixed columns."""
    return F.expm1(F.lag("__year", MONTH).over(by_entity()))


def reversal(n: int) -> Column:
    return -compounded("ret", -(n - 1), 0)


def with_distance_to_high(panel: DataFrame, out: str = "dist_high") -> DataFrame:
    """Adds the close over the highest high of the year's sessions."""
    d = with_extremes(panel, {"__top": ("max", "high", YEAR, 0)})
    return d.withColumn(out, safe_div("close", "__top")).drop("__top")


def with_previous_extremes(panel: DataFrame, wanted: dict[str, tuple[str, int]], c: str = "close") -> DataFrame:
    """Adds extremes of ``c`` over the n own sessions before the present one: ``{name: (max or min, n)}``."""
    return with_extremes(panel, {name: (kind, c, n, 1) for name, (kind, n) in wanted.items()})


def trend_signals(panel: DataFrame) -> DataFrame:
    """Momentum, reversals, distance to the year's high and moving-average ratios; prices enter as absolute values."""
    d = with_distance_to_high(panel.withColumns({c: F.abs(c) for c in ("close", "high")}))
    d = prefixed(d, {"close": F.col("close"), "log_ret": log1p_safe("ret")}).withColumn("__year", window_sum("log_ret", YEAR))
    d = d.withColumns({"mom": momentum(), "rev_month": reversal(MONTH), "rev_week": reversal(WEEK)} | {f"ma{n}": safe_div(window_sum("close", n) / n, "close") for n in MA_LENGTHS})
    return without_prefixes(d).drop("__year")


def rolling_beta(panel: DataFrame, market: DataFrame, n: int = YEAR) -> DataFrame:
    """Covariance with the market over its variance; ``market`` has date and mkt_ret and is as small as the calendar.

    Both come from sums of an entity's returns less its own means, so that no small difference of large sums is taken.
    """
    d = panel.join(F.broadcast(market), "date", "left")
    own = Window.partitionBy("entity")
    x, y = F.col("ret") - F.avg("ret").over(own), F.col("mkt_ret") - F.avg("mkt_ret").over(own)
    d = d.withColumns({"__x": x, "__y": y})
    d = prefixed(d, {"x": F.col("__x"), "y": F.col("__y"), "xy": F.col("__x") * F.col("__y"), "yy": F.col("__y") * F.col("__y")})
    sx, sy = window_sum("x", n), window_sum("y", n)
    beta = safe_div(window_sum("xy", n) - sx * sy / n, window_sum("yy", n) - sy * sy / n)
    return without_prefixes(d.withColumn("beta", beta)).drop("__x", "__y")


def rolling_vol(n: int = MONTH) -> Column:
    return rolling(F.stddev_samp, "ret", -(n - 1), 0)


def dollar_volume() -> Column:
    return F.abs("close") * F.col("vol")


def zero_trade(n: int = MONTH) -> Column:
    idle = F.when(F.col("vol").isNull() | (F.col("vol") <= 0), 1).otherwise(0)
    return rolling(F.sum, idle, -(n - 1), 0)


def illiquidity(n: int = MONTH) -> Column:
    """Mean of absolute return over dollar volume; a session without volume leaves the window NULL."""
    return rolling(F.avg, safe_div(F.abs("ret"), dollar_volume()), -(n - 1), 0)


def lag_week_return() -> Column:
    return compounded("ret", -(WEEK - 1), 0)


def liquidity_panel(panel: DataFrame, market: DataFrame) -> DataFrame:
    return rolling_beta(panel, market).withColumns({
        "volatility": rolling_vol(), "dollar_vol": dollar_volume(), "zero_trade": zero_trade(), "illiquidity": illiquidity(), "lag_week_ret": lag_week_return()})


def on_balance_volume(panel: DataFrame) -> DataFrame:
    """Running sum of volume, signed by the change of the close (a zero change adds); a missing change adds nothing."""
    last = F.lag("close").over(by_entity())
    vol = F.coalesce(finite("vol"), F.lit(0.0))
    step = F.when(F.col("close") >= last, vol).when(F.col("close") < last, -vol).otherwise(F.lit(0.0))
    d = panel.withColumn("__step", step)
    return d.withColumn("obv", F.sum("__step").over(by_entity().rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def threshold_cross(left: Column, right: Column, band: float = 0.0) -> Column:
    """1 above right * (1 + band), -1 below right * (1 - band), which wins, else 0."""
    return F.coalesce(F.when(left < right * (1 - band), -1).when(left > right * (1 + band), 1), F.lit(0))


def confirmed(raw: str, d: int) -> Column:
    """The raw signal once it has stood for ``d`` sessions in a row, else 0."""
    frame = by_entity().rowsBetween(-(d - 1), 0)
    full = F.count(raw).over(frame) == d
    return F.when(full & (F.min(raw).over(frame) == 1), 1).when(full & (F.max(raw).over(frame) == -1), -1).otherwise(0)


def carried(raw: str) -> Column:
    """The latest signal that is not zero, or zero."""
    frame = by_entity().rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(F.when(F.col(raw) != 0, F.col(raw)), True).over(frame), F.lit(0))


def holding_returns(prices: DataFrame, h: int) -> DataFrame:
    """Return over the next h sessions of one series, where all of them are there."""
    return prices.withColumn("hold_ret", compounded("ret", 1, h)).where("hold_ret is not null")


def fill_session(prices: DataFrame, date: str, columns: tuple[str, ...] = ("open", "high", "low", "close", "vol")) -> DataFrame:
    """Insert a session that every entity lacks at ``date``: the middle of its neighbours."""
    at = F.lit(date).cast("date")
    before = prices.where(F.col("date") < at).groupBy("entity").agg(*(F.max_by(c, "date").alias(f"a_{c}") for c in columns))
    after = prices.where(F.col("date") > at).groupBy("entity").agg(*(F.min_by(c, "date").alias(f"b_{c}") for c in columns))
    there = prices.where(F.col("date") == at).select("entity")
    new = before.join(after, "entity").join(there, "entity", "left_anti").select("entity", at.alias("date"), *(((F.col(f"a_{c}") + F.col(f"b_{c}")) / 2).alias(c) for c in columns))
    return prices.select("entity", "date", *columns).unionByName(new)


def chain_adjusted(panel: DataFrame) -> DataFrame:
    """Prices chained from the first close through returns: adj_close starts at 1; a missing return leaves a blank and
    the chain goes on; -100 % pins it to zero."""
    w = by_entity()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = panel.withColumn("__i", F.row_number().over(w)).withColumn("__r", F.when(F.col("__i") > 1, finite("ret")))
    growth = F.coalesce(F.sum(log1p_safe("__r")).over(upto), F.lit(0.0))
    dead = F.coalesce(F.max(F.when(F.col("__r") <= -1, 1)).over(upto), F.lit(0))
    d = d.withColumn("adj_close", F.when((F.col("__i") == 1) & F.col("close").isNotNull(), F.lit(1.0)).when(F.col("__r").isNull(), None).when(dead == 1, F.lit(0.0)).otherwise(F.exp(growth)))
    scale = safe_div("adj_close", F.abs("close"))
    return d.withColumns({f"adj_{c}": F.abs(c) * scale for c in ("open", "high", "low")}).drop("__i", "__r")


def rebased(panel: DataFrame, n: int) -> DataFrame:
    """adj_close relative to that of the first row of the n-row window that ends here; NULL for short windows or a zero
    or missing base."""
    base = F.lag("adj_close", n - 1).over(by_entity())
    return panel.withColumn("rebased", safe_div("adj_close", base))


def cumulative_log_return(series: DataFrame, ret: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(log1p_safe(ret)).over(w)


def vol_scaled(series: DataFrame, ret: str, by: list[str], benchmark_vol: float | Column) -> DataFrame:
    """Returns scaled so that each series has the benchmark's volatility."""
    vol = F.stddev_samp(ret).over(Window.partitionBy(*by))
    bench = benchmark_vol if isinstance(benchmark_vol, Column) else F.lit(benchmark_vol)
    return series.withColumn(f"{ret}_scaled", F.col(ret) * safe_div(bench, vol))
