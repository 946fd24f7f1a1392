"""Quantile portfolios: returns, turnover, high minus low, performance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions.expr import finite, log1p_safe, safe_div
from ..spec import SCHEMES
from .rules import BLOCK, unpack_cells
from .stats import mean_t
from .xsection import quantile_groups, scheme_weight, standardised

#: Metrics of a performance table and the digits they are rounded to (fixed values).
METRICS = ("ann_ret", "ann_risk", "sharpe", "act_ret", "act_risk", "info_ratio", "max_dd", "act_max_dd", "turnover")
DIGITS = (4, 4, 3, 4, 4, 3, 4, 4, 2)
#: Group number that stands for high minus low.
HIGH_LOW = 0


def ranked(panel: DataFrame, groups: int = 10, direct: bool = False, keys: tuple[str, ...] = (), thin: str = "raise") -> DataFrame:
    """Rows with signal and return, standardised per date (and ``keys``) unless ``direct``, in groups."""
    d = panel.withColumns({"signal": finite("signal"), "ret": finite("ret")}).dropna(subset=["signal", "ret"])
    by = (*keys, "date")
    if not direct:
        d = standardised(d, by=by).dropna(subset=["signal"])
    return quantile_groups(d, groups, by=by, thin=thin)


def weighted(ranked_panel: DataFrame, schemes=SCHEMES, float_cap: str = "cap", total_cap: str = "cap") -> DataFrame:
    """One row per name and scheme with weight w; groups are assigned once, before names without a cap go."""
    d = ranked_panel.withColumn("scheme", F.explode(F.array(*map(F.lit, schemes))))
    return d.withColumn("w", scheme_weight(F.col("scheme"), float_cap, total_cap)).where("w is not null")


def portfolio_returns(w: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per scheme, date and group: raw return, the market's average, and active return. Rows that ``ranked`` has dealt by
    date are not shuffled again."""
    by = [*keys, "scheme", "date"]
    g = w.groupBy(*by, "grp").agg(F.sum(F.col("w") * F.col("ret")).alias("__wr"), F.sum("w").alias("__w"), F.count("*").alias("n"))
    all_ = Window.partitionBy(*by)
    g = g.withColumn("raw", F.col("__wr") / F.col("__w")).withColumn("mkt", F.sum("__wr").over(all_) / F.sum("__w").over(all_))
    return g.select(*by, "grp", "n", "raw", "mkt", (F.col("raw") - F.col("mkt")).alias("act"))


def high_minus_low(port: DataFrame, groups: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per scheme and date: raw and active return of the top group less the bottom one; NULL if either is missing."""
    leg = lambda c, g: F.max(F.when(F.col("grp") == g, F.col(c)))
    return port.groupBy(*keys, "scheme", "date").agg((leg("raw", groups) - leg("raw", 1)).alias("raw"), (leg("act", groups) - leg("act", 1)).alias("act"))


def with_high_low(port: DataFrame, groups: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``port`` and, as group 0, its high minus low: a date's groups meet once and leave with one row more."""
    by = [*keys, "scheme", "date"]
    own = F.collect_list(F.struct("grp", "raw", "act"))
    leg = lambda c, g: F.max(F.when(F.col("grp") == g, F.col(c)))
    both = port.groupBy(*by).agg(own.alias("own"), F.struct(F.lit(HIGH_LOW).alias("grp"), (leg("raw", groups) - leg("raw", 1)).alias("raw"), (leg("act", groups) - leg("act", 1)).alias("act")).alias("hl"))
    return both.select(*by, F.explode(F.concat("own", F.array("hl"))).alias("x")).select(*by, "x.*")


def turnover_by_date(w: DataFrame, drop_last: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum of absolute changes of normalised weights, by scheme, date and group, from a date to the next one of ``w``.

    At the last date all weights count as sold, unless ``drop_last``. A name's weights meet in one window over its own
    rows: each row gives its change to the next date, and, where the name was not there at the date before, what is
    bought then. Dates are a dimension with a row each, which is broadcast where ``keys`` do not multiply it.
    """
    dates = w.select(*keys, "date").distinct()
    over = Window.partitionBy(*keys).orderBy("date")
    dates = dates.select(*keys, "date", F.lag("date").over(over).alias("__before"), F.lead("date").over(over).alias("__after"))
    norm = w.select(*keys, "scheme", "entity", "grp", "date", (F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "scheme", "date", "grp"))).alias("__p"))
    norm = norm.join(dates if keys else F.broadcast(dates), [*keys, "date"])
    own = Window.partitionBy(*keys, "scheme", "entity", "grp").orderBy("date")
    kept = F.when(F.lead("date").over(own) == F.col("__after"), F.lead("__p").over(own)).otherwise(0.0)
    there = F.coalesce(F.lag("date").over(own) == F.col("__before"), F.lit(False))
    d = norm.withColumns({"__out": F.abs(F.col("__p") - kept), "__in": F.when(F.col("__before").isNotNull() & ~there, F.col("__p"))})
    last = F.col("__after").isNull()
    moves = F.filter(F.array(
        F.struct(F.col("date").alias("date"), (F.when(~last, F.col("__out")) if drop_last else F.col("__out")).alias("c")),
        F.struct(F.col("__before").alias("date"), F.col("__in").alias("c"))), lambda m: m["c"].isNotNull())
    return d.select(*keys, "scheme", "grp", F.explode(moves).alias("m")).groupBy(*keys, "scheme", F.col("m.date").alias("date"), "grp").agg(F.sum("m.c").alias("turnover"))


def _falls(ret: str, by: list[str]) -> tuple[dict, Column]:
    """Columns of a cumulated return and its fall below the peak so far, to be added in turn, and the aggregate of the
    largest fall; NULL if any return is missing."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    steps = {f"__cum_{ret}": F.exp(F.sum(log1p_safe(ret)).over(w)), f"__fall_{ret}": F.col(f"__cum_{ret}") / F.max(f"__cum_{ret}").over(w) - 1}
    return steps, F.when(F.count(ret) == F.count(F.lit(1)), -F.min(f"__fall_{ret}"))


def max_drawdown(series: DataFrame, ret: str, by: list[str]) -> DataFrame:
    """Largest fall of the cumulated return below its peak so far; NULL if any return is missing."""
    steps, worst = _falls(ret, by)
    d = series
    for name, c in steps.items():
        d = d.withColumn(name, c)
    return d.groupBy(*by).agg(worst.alias("max_dd"))


def performance(port: DataFrame, turnover: DataFrame, groups: int, ppy: int, rounded: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Long table (scheme, grp, metric, value); group 0 is high minus low. Ratios come from unrounded values.

    All of a series' metrics are one pass: its windows and aggregates share the partitioning by scheme and group.
    """
    p, root = float(ppy), float(ppy) ** 0.5
    by = [*keys, "scheme", "grp"]
    (raw, worst), (act, act_worst) = _falls("raw", by), _falls("act", by)
    s = with_high_low(port, groups, keys)
    for a, b in zip(raw.items(), act.items()):
        s = s.withColumns(dict((a, b)))
    stats = s.groupBy(*by).agg(
        (F.avg("raw") * p).alias("ann_ret"), (F.stddev_samp("raw") * root).alias("ann_risk"), (F.avg("act") * p).alias("act_ret"), (F.stddev_samp("act") * root).alias("act_risk"),
        worst.alias("max_dd"), act_worst.alias("act_max_dd"))
    stats = stats.withColumns({"sharpe": safe_div("ann_ret", "ann_risk"), "info_ratio": safe_div("act_ret", "act_risk")})
    to = turnover.groupBy(*by).agg((F.avg("turnover") * p).alias("turnover"))
    leg = F.when(F.col("grp").isin(1, groups), F.col("turnover"))
    both = to.groupBy(*by[:-1]).agg(F.collect_list(F.struct("grp", "turnover")).alias("own"), F.struct(F.lit(HIGH_LOW).alias("grp"), (F.sum(leg) / 2).alias("turnover")).alias("hl"))
    wide = stats.join(both.select(*by[:-1], F.explode(F.concat("own", F.array("hl"))).alias("x")).select(*by[:-1], "x.*"), by, "left")
    value = [F.round(F.col(m), d) if rounded else F.col(m) for m, d in zip(METRICS, DIGITS)]
    return wide.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in zip(METRICS, value)))).alias("x")).select(*by, "x.metric", "x.value")


def backtest(panel: DataFrame, groups: int = 10, ppy: int = 52, schemes=SCHEMES, direct: bool = False, keys: tuple[str, ...] = (), thin: str = "raise", float_cap: str = "cap", total_cap: str = "cap") -> DataFrame:
    """A panel (entity, date, signal, ret, cap) to its long performance table, with the t statistic of high minus low.

    ``keys`` (a model, a horizon) part one panel into several that are tested side by side, in one plan.
    """
    w = weighted(ranked(panel, groups, direct, keys, thin), schemes, float_cap, total_cap)
    port = portfolio_returns(w, keys)
    perf = performance(port, turnover_by_date(w, keys=keys), groups, ppy, keys=keys)
    t = mean_t(high_minus_low(port, groups, keys).withColumn("grp", F.lit(HIGH_LOW)), "raw", [*keys, "scheme", "grp"])
    return perf.unionByName(t.select(*keys, "scheme", "grp", F.lit("nw_t").alias("metric"), F.round("t", 2).alias("value")))


def wide(perf: DataFrame, by: list[str], groups: int = 10) -> DataFrame:
    """One row per key with a column for each metric and group, high minus low first."""
    names = [f"{m}_{'DH' if g == HIGH_LOW else f'D{g:02d}'}" for m in METRICS for g in range(groups + 1)]
    d = perf.withColumn("__name", F.concat_ws("_", "metric", F.when(F.col("grp") == HIGH_LOW, "DH").otherwise(F.format_string("D%02d", "grp"))))
    return d.groupBy(*by).pivot("__name", names).agg(F.first("value"))


def holding_split(first: Column, whole: Column, strict: bool = True) -> tuple[Column, Column]:
    """Return of the first days and of the days after them, from the first days' and the whole period's.

    A return of -100 % or less in the first days leaves no later one: it raises, or with ``strict`` off gives NULL.
    """
    gone = F.raise_error(F.lit("a return of -100 % or less in the first days")).cast("double") if strict else F.lit(None).cast("double")
    return first, F.when(first > -1, (1 + whole) / (1 + first) - 1).when(first <= -1, gone)


def sharpe_summary(returns: DataFrame, ret: str, by: list[str], ppy: int) -> DataFrame:
    """Periods, annualised return and risk, and Sharpe ratio; NULL below two periods, or without risk."""
    p, root = float(ppy), float(ppy) ** 0.5
    s = returns.groupBy(*by).agg(F.count(ret).alias("n_periods"), (F.avg(ret) * p).alias("ann_ret"), (F.stddev_samp(ret) * root).alias("ann_risk"))
    ok = F.col("n_periods") >= 2
    return s.select(*by, "n_periods", F.when(ok, F.col("ann_ret")).alias("ann_ret"), F.when(ok, F.col("ann_risk")).alias("ann_risk"), F.when(ok & (F.col("ann_risk") > 0), safe_div("ann_ret", "ann_risk")).alias("sharpe"))


def rule_high_low(positions: DataFrame, groups: int) -> DataFrame:
    """High minus low per date, rule and scheme from a long table (rule_id, entity, date, pos, ret, w-less caps).

    Dates with fewer rankable names than groups, and dates where a leg is empty, drop out.
    """
    by = ("rule_id", "date")
    d = positions.withColumns({"signal": finite("pos"), "ret": finite("ret")}).dropna(subset=["signal", "ret"])
    d = standardised(d, by=by).dropna(subset=["signal"])
    d = quantile_groups(d, groups, by=by, thin="drop")
    w = weighted(d).where(F.col("grp").isin(1, groups))
    leg = lambda g: safe_div(F.sum(F.when(F.col("grp") == g, F.col("w") * F.col("ret"))), F.sum(F.when(F.col("grp") == g, F.col("w"))))
    return w.groupBy("rule_id", "scheme", "date").agg((leg(groups) - leg(1)).alias("hl")).where("hl is not null")


#: Cells of the matrix that are ranked at once.
CELLS = 1 << 19


def cells_high_low(cells: np.ndarray, ret: np.ndarray, weights: np.ndarray, groups: int) -> np.ndarray:
    """High minus low by scheme and rule, NaN where there is none, of one date: ``cells`` names x rules (position plus
    one, 3 for none), finite returns, and weights schemes x names (0: none), names in order of entity.

    As there are three positions only, a rule's standardised cross-section has three values at most: they follow from
    counts, and a name's rank from the counts below its value and from the names before it that share it.
    """
    cells = np.ascontiguousarray(cells.T)
    count = np.stack([np.count_nonzero(cells == k, axis=1) for k in range(3)]).astype(np.float64)
    n = count.sum(axis=0)
    usable = (n >= groups) & ((count > 0).sum(axis=0) > 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        value = np.arange(-1.0, 2.0)[:, None]
        mean = (count * value).sum(axis=0) / n
        z = np.clip((value - mean) / np.sqrt((count * (value - mean) ** 2).sum(axis=0) / (n - 1)), -3, 3)
        # clipped values may coincide: then their names are ties
        kind = np.vstack([np.zeros(len(n), np.int8), np.cumsum(z[1:] > z[:-1], axis=0)]).astype(np.int8)
    tied = (kind != np.arange(3)[:, None]).any(axis=0) & usable
    low, high = _legs(cells, count, groups)
    if tied.any():
        tied_low, tied_high = _tied_legs(np.ascontiguousarray(cells[tied].T), kind[:, tied], n[tied], groups)
        low[tied], high[tied] = tied_low.T, tied_high.T
    both = np.vstack([weights * ret, weights]).T
    with np.errstate(invalid="ignore", divide="ignore"):
        leg = lambda side: np.divide(*np.split((side.astype(np.float64) @ both).T, 2))
        out = leg(high) - leg(low)
    return np.where(usable, out, np.nan)


def _legs(cells: np.ndarray, count: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Rules x names (as ``cells`` are here): whether a name is in the lowest or the highest group, where the three
    positions rank apart. Below the position at which a leg ends all names are in it, and of those at it the first ones."""
    n, upto = count.sum(axis=0).astype(np.int64), np.cumsum(count, axis=0).astype(np.int64)
    out = []
    for first in (-(-n // groups), -(-n * (groups - 1) // groups)):
        # the position of the last of the first ``first`` names, and how many of them have it
        at = (upto < first).sum(axis=0).astype(np.uint8)
        mine = first - np.where(at > 0, np.take_along_axis(upto, np.maximum(at.astype(np.int64) - 1, 0)[None], axis=0)[0], 0)
        same = cells == at[:, None]
        out.append((cells < at[:, None]) | (same & (np.cumsum(same, axis=1, dtype=np.int32) <= mine[:, None].astype(np.int32))))
    return out[0], ~out[1] & (cells < 3)


def _tied_legs(cells: np.ndarray, kind: np.ndarray, n: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Names x rules: the legs where positions share a standardised value, which ``kind`` numbers by position."""
    there = cells < 3
    own = np.take_along_axis(np.vstack([kind, np.full((1, len(n)), 9, np.int8)]), cells.astype(np.int64), axis=0)
    rank, below = np.zeros(cells.shape, np.int64), np.zeros(len(n), np.int64)
    for k in range(3):
        same = own == k
        rank = np.where(same, below + np.cumsum(same, axis=0) - 1, rank)
        below = below + same.sum(axis=0)
    return there & (rank * groups < n), there & (rank * groups >= n * (groups - 1))


def packed_high_low(packed: DataFrame, rule_ids: list[int], groups: int, schemes=SCHEMES, float_cap: str = "cap", total_cap: str = "cap", block: int = BLOCK) -> DataFrame:
    """rule_id, scheme, date, hl from a matrix of positions (entity, date, ret, caps, block, bits): one shuffle by date and
    block, all rules of a block ranked side by side. Dates with fewer rankable names than groups, and dates where a leg is
    empty, have no row."""
    ids = np.array(rule_ids, np.int32)
    d = packed.withColumn("ret", finite("ret")).where("ret is not null")
    d = d.select("entity", "date", "block", "bits", "ret", *(F.coalesce(scheme_weight(s, float_cap, total_cap), F.lit(0.0)).alias(f"w{i}") for i, s in enumerate(schemes)))
    ship(packed.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("entity")
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        ret, w = np.asarray(t["ret"]), np.stack([np.asarray(t[f"w{i}"]) for i in range(len(schemes))])
        first = t["block"][0].as_py() * block
        own = ids[first : first + block]
        width = max(1, CELLS // (4 * t.num_rows))
        parts = [cells_high_low(unpack_cells(bits[:, b : b + width]), ret, w, groups) for b in range(0, bits.shape[1], width)] if t.num_rows >= groups else [np.full((len(schemes), len(own)), np.nan)]
        hl = np.concatenate(parts, axis=1)[:, : len(own)]
        scheme, rule = np.nonzero(np.isfinite(hl))
        return pa.table({"rule_id": pa.array(own[rule]), "scheme": pa.array([schemes[i] for i in scheme], pa.string()), "date": t["date"].take(pa.array(np.zeros(len(rule), np.int64))), "hl": pa.array(hl[scheme, rule])})

    return d.groupBy("date", "block").applyInArrow(run, f"rule_id int, scheme string, date {packed.schema['date'].dataType.simpleString()}, hl double")


def every_rule(summary: DataFrame, rule_ids: list[int], schemes=SCHEMES) -> DataFrame:
    """A Sharpe summary with a row for every rule and scheme: those without a date have 0 periods and no figures."""
    spark = summary.sparkSession
    all_ = spark.createDataFrame([(i,) for i in rule_ids], "rule_id int").select("rule_id", F.explode(F.array(*map(F.lit, schemes))).alias("scheme"))
    return all_.join(summary, ["rule_id", "scheme"], "left").withColumn("n_periods", F.coalesce("n_periods", F.lit(0).cast("long")))


def sharpe_distribution(summary: DataFrame, bins: int = 80, reference: float | None = None, pad: float = 0.05) -> DataFrame:
    """Histogram of Sharpe ratios by scheme: bin, n, its edges, and the axis' limits, which take in the reference and a
    share ``pad`` of the span to both sides, or 0.5 where there is no span. Equal ratios lie in a bin around them."""
    v = summary.where(finite("sharpe").isNotNull()).select("scheme", finite("sharpe").alias("v"))
    ends = v.groupBy("scheme").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    flat = F.col("a") == F.col("b")
    ref = F.lit(reference).cast("double")
    left, right = F.least("a", ref), F.greatest("b", ref)
    margin = F.when(right > left, pad * (right - left)).otherwise(0.5)
    ends = ends.select("scheme", F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"), (left - margin).alias("x_lo"), (right + margin).alias("x_hi"))
    bin_ = F.least(F.lit(bins), F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1).cast("int")
    return v.join(F.broadcast(ends), "scheme").groupBy("scheme", bin_.alias("bin"), "lo", "hi", "x_lo", "x_hi").agg(F.count("*").alias("n")).select(
        "scheme", "bin", "n", (F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / bins).alias("left"), (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("right"), "x_lo", "x_hi")


def histogram(values: DataFrame, c: str, bins: int = 80) -> DataFrame:
    """Counts in equal bins between the smallest and the largest value."""
    v = values.where(finite(c).isNotNull()).select(finite(c).alias("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = v.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.lit(bins), F.floor(safe_div((F.col("v") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))) + 1))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(F.col("bin").cast("int").alias("bin"), "n", "lo", "hi")


def positive_rate(train: DataFrame, y: str, least: int = 12) -> DataFrame:
    """Share of ones per entity, or the overall share for entities with fewer than ``least`` rows."""
    overall = train.agg(F.avg(y).alias("__all"))
    g = train.groupBy("entity").agg(F.count(y).alias("n"), F.avg(y).alias("__own"))
    return g.crossJoin(F.broadcast(overall)).select("entity", "n", F.when(F.col("n") >= least, F.col("__own")).otherwise(F.col("__all")).alias("p_bench"))
