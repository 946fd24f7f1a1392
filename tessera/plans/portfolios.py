"""Queries on cross-sections, portfolios, statistics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import compounded, safe_div
from ..operators import asof, portfolio, regress, report, rules, signals, stats, xsection
from ..sources.panels import ev_daily, period_panel, su_daily, table
from .series import rounded
from .sqlkit import backtest_sql, comp, roll, sql

Q: dict = {}
S: dict = {}
GROUPS = 5


def query(sql_text: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql_text is not None:
            S[f.__name__] = sql_text
        return f

    return add


def panel(spark, sf) -> DataFrame:
    """Signal: a day's return; outcome: the next one's."""
    ev = ev_daily(spark, sf)
    d = ev.select("entity", "date", F.col("ret").alias("signal"), F.lead("ret").over(Window.partitionBy("entity").orderBy("date")).alias("ret"), "cap")
    return d.dropna(subset=["signal", "ret"])


def weights(spark, sf) -> DataFrame:
    return portfolio.weighted(portfolio.ranked(panel(spark, sf), GROUPS, thin="drop"))


def hl_series(spark, sf, groups: int = GROUPS) -> DataFrame:
    port = portfolio.portfolio_returns(portfolio.weighted(portfolio.ranked(panel(spark, sf), groups, thin="drop")))
    return rounded(portfolio.high_minus_low(port, groups), "raw", "act")


Q["hl_series"] = hl_series
S["hl_series"] = sql("hl", "SELECT scheme, date, round(raw, 6) AS raw, round(act, 6) AS act FROM hl")


@query(sql("mkt", "SELECT date, round(mkt_ret, 6) AS mkt_ret FROM mkt"))
def market_vw_return(spark, sf):
    return rounded(xsection.market_return(su_daily(spark, sf)), "mkt_ret")


@query(sql("std", "SELECT entity, date, round(signal, 6) AS signal FROM std"))
def xs_standardize(spark, sf):
    return rounded(xsection.standardised(panel(spark, sf)).select("entity", "date", "signal"), "signal")


@query(sql("grp", "SELECT entity, date, grp, printf('D%02d', grp) AS label FROM grp"))
def quantile_groups(spark, sf):
    return portfolio.ranked(panel(spark, sf), GROUPS, thin="drop").select("entity", "date", "grp", xsection.group_name(F.col("grp")).alias("label"))


@query(sql("panel", "SELECT entity, date, grp FROM (SELECT entity, date, CAST(least(5, floor((row_number() OVER (PARTITION BY date ORDER BY signal, entity) - 1) * 5 / count(*) OVER (PARTITION BY date)) + 1) AS INTEGER) AS grp, count(*) OVER (PARTITION BY date) AS n FROM panel) WHERE n >= 5"))
def direct_signal_groups(spark, sf):
    return portfolio.ranked(panel(spark, sf), GROUPS, direct=True, thin="drop").select("entity", "date", "grp")


_RANK = "rank() OVER (PARTITION BY date ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2"


@query(sql("ev", f"SELECT entity, date, CAST({_RANK.format(c='vol')} AS DOUBLE) AS vol_rank, round(({_RANK.format(c='vol')}) / count(vol) OVER (PARTITION BY date), 6) AS vol_pct FROM ev"))
def xs_rank(spark, sf):
    return ev_daily(spark, sf).select("entity", "date", xsection.average_rank("vol").alias("vol_rank"), F.round(xsection.percentile_rank("vol"), 6).alias("vol_pct"))


@query(sql("panel", f"SELECT date, n, round(rho, 6) AS rho FROM (SELECT date, count(*) AS n, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS rho FROM (SELECT date, {_RANK.format(c='signal')} AS a, {_RANK.format(c='cap')} AS b FROM panel) GROUP BY date) WHERE n >= 30"))
def spearman_by_date(spark, sf):
    return rounded(xsection.spearman(panel(spark, sf), "signal", "cap"), "rho")


@query(sql("panel", f"""SELECT n, lag, round(mean, 6) AS mean, round(mean / nullif(se, 0), 4) AS t FROM q3 WHERE n IS NOT NULL""", f"""
r0 AS (SELECT date, count(*) AS n, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS x FROM (SELECT date, {_RANK.format(c='signal')} AS a, {_RANK.format(c='cap')} AS b FROM panel) GROUP BY date HAVING count(*) >= 30),
q0 AS (SELECT date, x, x - avg(x) OVER () AS e, count(*) OVER () AS n, row_number() OVER (ORDER BY date) AS i FROM r0 WHERE x IS NOT NULL),
q1 AS (SELECT *, CAST(least(greatest(floor(4 * pow(n / 100.0, 2.0 / 9.0)), 1), n - 1) AS INTEGER) AS lag FROM q0),
q2 AS (SELECT max(a.n) AS n, max(a.lag) AS lag, sum(CASE WHEN b.i = a.i THEN 1.0 ELSE 2 * (1 - (b.i - a.i) / (a.lag + 1.0)) END * a.e * b.e) AS s FROM q1 a JOIN q1 b ON b.i BETWEEN a.i AND a.i + a.lag),
q3 AS (SELECT q2.n, q2.lag, m.mean, sqrt(greatest(s, 0) / q2.n / q2.n) AS se FROM q2, (SELECT avg(x) AS mean FROM q0) m)"""))
def rank_correlation_t(spark, sf):
    rho = xsection.spearman(panel(spark, sf), "signal", "cap").withColumn("k", F.lit(1))
    return stats.mean_t(rho, "rho", ["k"]).select("n", "lag", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"))


@query(sql("port", "SELECT scheme, date, grp, n, round(raw, 6) AS raw, round(mkt, 6) AS mkt, round(act, 6) AS act FROM port"))
def portfolio_returns(spark, sf):
    return rounded(portfolio.portfolio_returns(weights(spark, sf)), "raw", "mkt", "act")


@query(sql("turn", "SELECT scheme, date, grp, round(turnover, 6) AS turnover FROM turn"))
def turnover(spark, sf):
    return rounded(portfolio.turnover_by_date(weights(spark, sf)), "turnover")


@query(sql("dd", "SELECT scheme, grp, round(max_dd, 6) AS max_dd, round(act_max_dd, 6) AS act_max_dd FROM dd"))
def max_drawdown(spark, sf):
    s = portfolio.with_high_low(portfolio.portfolio_returns(weights(spark, sf)), GROUPS)
    a = portfolio.max_drawdown(s, "raw", ["scheme", "grp"])
    return rounded(a.join(portfolio.max_drawdown(s, "act", ["scheme", "grp"]).withColumnRenamed("max_dd", "act_max_dd"), ["scheme", "grp"]), "max_dd", "act_max_dd")


def _perf(spark, sf):
    w = weights(spark, sf)
    return portfolio.performance(portfolio.portfolio_returns(w), portfolio.turnover_by_date(w), GROUPS, 52)


@query(sql("perf", "SELECT scheme, grp, metric, value FROM perf"))
def h1_perf_long(spark, sf):
    return _perf(spark, sf)


@query(sql("perf", "SELECT scheme, " + ", ".join(f"max(CASE WHEN metric = '{m}' AND grp = {g} THEN value END) AS {m}_{n}" for m in portfolio.METRICS for g, n in ((0, "DH"), *((g, f"D{g:02d}") for g in range(1, GROUPS + 1)))) + " FROM perf GROUP BY scheme"))
def h1_perf_wide(spark, sf):
    return portfolio.wide(_perf(spark, sf), ["scheme"], GROUPS)


_NW = """
q0 AS (SELECT scheme, date, raw AS x, raw - avg(raw) OVER (PARTITION BY scheme) AS e, count(*) OVER (PARTITION BY scheme) AS n, row_number() OVER (PARTITION BY scheme ORDER BY date) AS i FROM hl WHERE raw IS NOT NULL),
q1 AS (SELECT *, CAST(least(greatest(floor(4 * pow(n / 100.0, 2.0 / 9.0)), 1), n - 1) AS INTEGER) AS lag FROM q0),
q2 AS (SELECT a.scheme, max(a.n) AS n, max(a.lag) AS lag, sum(CASE WHEN b.i = a.i THEN 1.0 ELSE 2 * (1 - (b.i - a.i) / (a.lag + 1.0)) END * a.e * b.e) AS s FROM q1 a JOIN q1 b ON a.scheme = b.scheme AND b.i BETWEEN a.i AND a.i + a.lag GROUP BY 1),
q3 AS (SELECT q2.*, m.mean, m.mean / nullif(sqrt(greatest(s, 0) / n / n), 0) AS t FROM q2 JOIN (SELECT scheme, avg(x) AS mean FROM q0 GROUP BY 1) m USING (scheme))"""
_STARS = "CASE WHEN t IS NULL THEN '' WHEN abs(t) >= 2.576 THEN '***' WHEN abs(t) >= 1.96 THEN '**' WHEN abs(t) >= 1.645 THEN '*' ELSE '' END"


@query(sql("hl", f"SELECT scheme, n, lag, round(mean, 6) AS mean, round(t, 4) AS t, {_STARS} AS stars FROM q3", _NW))
def newey_west_t(spark, sf):
    port = portfolio.portfolio_returns(weights(spark, sf))
    t = stats.mean_t(portfolio.high_minus_low(port, GROUPS), "raw", ["scheme"])
    return t.select("scheme", "n", "lag", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"), stats.stars(F.col("t")).alias("stars"))


@query(sql("hl", "SELECT scheme, count(raw) AS n, round(avg(raw) / nullif(stddev_samp(raw) / sqrt(count(raw)), 0), 4) AS t FROM hl GROUP BY scheme"))
def plain_t(spark, sf):
    port = portfolio.portfolio_returns(weights(spark, sf))
    return stats.mean_t(portfolio.high_minus_low(port, GROUPS), "raw", ["scheme"], lags=None).select("scheme", "n", F.round("t", 4).alias("t"))


@query(sql("su", f"SELECT entity, date, round(f, 6) AS first_days, round(CASE WHEN f > -1 THEN (1 + h) / (1 + f) - 1 END, 6) AS later_days FROM (SELECT entity, date, {comp(1, 5)} AS f, {comp(1, 20)} AS h FROM su)"))
def holding_split(spark, sf):
    d = su_daily(spark, sf).select("entity", "date", compounded("ret", 1, 5).alias("f"), compounded("ret", 1, 20).alias("h"))
    a, b = portfolio.holding_split(F.col("f"), F.col("h"), strict=False)
    return rounded(d.select("entity", "date", a.alias("first_days"), b.alias("later_days")), "first_days", "later_days")


@query(sql("month", f"SELECT entity, period, round(1 / (1 + exp(-(close - open) / close)), 6) AS p, round(CASE WHEN ret > 0 THEN 1 WHEN ret IS NOT NULL THEN 0 END * CASE WHEN cap > 0 THEN cap END, 6) AS y FROM mo"))
def binary_targets(spark, sf):
    mo = period_panel(su_daily(spark, sf), "month")
    p = 1 / (1 + F.exp(-(F.col("close") - F.col("open")) / F.col("close")))
    return rounded(mo.select("entity", "period", p.alias("p"), (xsection.binary_target(F.col("ret")) * xsection.scheme_weight("total")).alias("y")), "p", "y")


@query(sql("month", "SELECT entity, n, round(CASE WHEN n >= 60 THEN own ELSE al END, 6) AS p_bench FROM (SELECT entity, count(y) AS n, avg(y) AS own FROM b GROUP BY entity), (SELECT avg(y) AS al FROM b)",
           "b AS (SELECT entity, CASE WHEN ret IS NULL THEN NULL WHEN ret > 0 THEN 1 ELSE 0 END AS y FROM mo)"))
def positive_benchmark(spark, sf):
    mo = period_panel(su_daily(spark, sf), "month").withColumn("y", xsection.binary_target(F.col("ret")))
    return rounded(portfolio.positive_rate(mo, "y", 60), "p_bench")


# --- rules -----------------------------------------------------------------------------------------------------------

_NATIVE = [r for r in rules.manifest() if rules.native(r)]


def _chosen():
    """A few rules of each native kind."""
    def pick(family, variant, **p):
        return next(r for r in _NATIVE if r.family == family and r.variant == variant and all(r.get(k) == v for k, v in p.items()))

    return [pick("MA", "cross", short=5, long=20), pick("MA", "cross_band", short=5, long=20, b=0.01), pick("MA", "single_delay", n=20, d=2), pick("OBV", "cross", short=5, long=20),
            pick("SR", "range", n=20), pick("SR", "extrema_band", e=5, b=0.02), pick("CB", "breakout", n=20, x=0.5), pick("FR", "extrema", x=0.05, e=5)]


def _rule_sql() -> str:
    hi, lo = (lambda n: roll("max", "close", -n, -1)), (lambda n: roll("min", "close", -n, -1))
    avg = lambda c, n: roll("avg", c, 1 - n, 0)
    cross = lambda a, b, band=0.0: f"coalesce(CASE WHEN ({a}) < ({b}) * (1 - {band}::DOUBLE) THEN -1 WHEN ({a}) > ({b}) * (1 + {band}::DOUBLE) THEN 1 END, 0)"
    c = _chosen()
    raw = {
        c[0].rule_id: cross(avg("close", 5), avg("close", 20)), c[1].rule_id: cross(avg("close", 5), avg("close", 20), 0.01), c[2].rule_id: cross("close", avg("close", 20)),
        c[3].rule_id: cross(avg("obv", 5), avg("obv", 20)), c[4].rule_id: f"coalesce(CASE WHEN close < ({lo(20)}) THEN -1 WHEN close > ({hi(20)}) THEN 1 END, 0)",
        c[5].rule_id: f"coalesce(CASE WHEN close < ({lo(5)}) * (1 - 0.02::DOUBLE) THEN -1 WHEN close > ({hi(5)}) * (1 + 0.02::DOUBLE) THEN 1 END, 0)",
        c[6].rule_id: f"coalesce(CASE WHEN ({hi(20)}) <= ({lo(20)}) * (1 + 0.5::DOUBLE) AND close < ({lo(20)}) THEN -1 WHEN ({hi(20)}) <= ({lo(20)}) * (1 + 0.5::DOUBLE) AND close > ({hi(20)}) THEN 1 END, 0)",
        c[7].rule_id: f"coalesce(CASE WHEN close <= ({hi(5)}) * (1 - 0.05::DOUBLE) THEN -1 WHEN close >= ({lo(5)}) * (1 + 0.05::DOUBLE) THEN 1 END, 0)",
    }
    extra = "ob AS (SELECT *, sum(CASE WHEN close >= pc THEN vol WHEN close < pc THEN -vol ELSE 0 END) OVER (PARTITION BY entity ORDER BY date) AS obv FROM (SELECT *, lag(close) OVER (PARTITION BY entity ORDER BY date) AS pc FROM su)),\n"
    extra += "raws AS (" + " UNION ALL ".join(f"SELECT entity, date, {i} AS rule_id, {x} AS raw0 FROM ob" for i, x in raw.items()) + "),\n"
    by = "(PARTITION BY entity, rule_id ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)"
    extra += f"""conf AS (SELECT entity, date, rule_id, CASE WHEN rule_id <> {c[2].rule_id} THEN raw0 WHEN count(raw0) OVER {by} = 2 AND min(raw0) OVER {by} = 1 THEN 1 WHEN count(raw0) OVER {by} = 2 AND max(raw0) OVER {by} = -1 THEN -1 ELSE 0 END AS raw FROM raws),
pos AS (SELECT entity, date, CAST(rule_id AS INTEGER) AS rule_id, CAST(coalesce(last_value(nullif(raw, 0) IGNORE NULLS) OVER (PARTITION BY entity, rule_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS TINYINT) AS pos FROM conf)"""
    return extra


@query(sql("su", "SELECT entity, date, rule_id, pos FROM pos", _rule_sql()))
def rule_positions_native(spark, sf):
    return rules.native_positions(su_daily(spark, sf), _chosen())


@query(sql("su", "SELECT entity, date, rule_id, pos FROM pos", _rule_sql()))
def rule_positions_kernel(spark, sf):
    return rules.positions(su_daily(spark, sf), _chosen())


def _sequential():
    return [r for r in rules.manifest() if not rules.native(r)]


@query()
def rule_positions_sequential(spark, sf):
    su = su_daily(spark, sf)
    as_of = period_panel(su, "month").select("entity", "date")
    return rules.sampled(su, _sequential(), as_of)


def _rule_returns(spark, sf):
    mo = period_panel(su_daily(spark, sf), "month")
    base = mo.select("entity", F.col("period").alias("date"), F.lead("ret").over(Window.partitionBy("entity").orderBy("date")).alias("ret"), "cap", F.col("ret").alias("r0"), "close", "open")
    pos = F.array(F.struct(F.lit(1).alias("rule_id"), F.col("r0").alias("pos")), F.struct(F.lit(2).alias("rule_id"), (F.col("close") / F.col("open")).alias("pos")))
    return base.select("entity", "date", "ret", "cap", F.explode(pos).alias("x")).select("entity", "date", "ret", "cap", "x.rule_id", "x.pos")


_RULE_HL = """
b AS (SELECT entity, period AS date, lead(ret) OVER (PARTITION BY entity ORDER BY date) AS ret, cap, ret AS r0, close / open AS r1 FROM mo),
u AS (SELECT entity, date, ret, cap, 1 AS rule_id, r0 AS signal FROM b UNION ALL SELECT entity, date, ret, cap, 2, r1 FROM b),
u0 AS (SELECT * FROM u WHERE signal IS NOT NULL AND ret IS NOT NULL),
u1 AS (SELECT *, (signal - avg(signal) OVER w) / nullif(stddev_samp(signal) OVER w, 0) AS z FROM u0 WINDOW w AS (PARTITION BY rule_id, date)),
u2 AS (SELECT * EXCLUDE (z), CASE WHEN z IS NOT NULL THEN greatest(least(z, 3.0), -3.0) END AS z FROM u1),
u3 AS (SELECT *, (z - avg(z) OVER w) / nullif(stddev_samp(z) OVER w, 0) AS s FROM u2 WINDOW w AS (PARTITION BY rule_id, date)),
u4 AS (SELECT *, count(*) OVER (PARTITION BY rule_id, date) AS n, row_number() OVER (PARTITION BY rule_id, date ORDER BY s, entity) AS rn FROM u3 WHERE s IS NOT NULL),
u5 AS (SELECT *, least(5, floor((rn - 1) * 5 / n) + 1) AS grp FROM u4 WHERE n >= 5),
u6 AS (SELECT u5.*, v.scheme, CASE WHEN v.scheme = 'equal' THEN 1.0 WHEN cap > 0 THEN cap END AS w FROM u5 CROSS JOIN (VALUES ('equal'), ('float'), ('total')) AS v(scheme) WHERE v.scheme = 'equal' OR cap > 0),
rhl AS (SELECT CAST(rule_id AS INTEGER) AS rule_id, scheme, date, sum(CASE WHEN grp = 5 THEN w * ret END) / sum(CASE WHEN grp = 5 THEN w END) - sum(CASE WHEN grp = 1 THEN w * ret END) / sum(CASE WHEN grp = 1 THEN w END) AS hl FROM u6 GROUP BY ALL)"""


@query(sql("month", "SELECT rule_id, scheme, date, round(hl, 6) AS hl FROM rhl WHERE hl IS NOT NULL", _RULE_HL))
def rule_high_low(spark, sf):
    return rounded(portfolio.rule_high_low(_rule_returns(spark, sf), GROUPS), "hl")


@query(sql("month", "SELECT rule_id, scheme, count(hl) AS n_periods, round(avg(hl) * 12.0, 6) AS ann_ret, round(stddev_samp(hl) * sqrt(12.0), 6) AS ann_risk, round(avg(hl) * 12.0 / nullif(stddev_samp(hl) * sqrt(12.0), 0), 6) AS sharpe FROM rhl WHERE hl IS NOT NULL GROUP BY 1, 2", _RULE_HL))
def rule_sharpe_summary(spark, sf):
    hl = portfolio.rule_high_low(_rule_returns(spark, sf), GROUPS)
    return rounded(portfolio.sharpe_summary(hl, "hl", ["rule_id", "scheme"], 12), "ann_ret", "ann_risk", "sharpe")


#: The scan of the rules that SQL knows, ranked in five groups on the rows of a universe.
_SCAN = _rule_sql() + f""",
a0 AS (SELECT entity, date, cap, CAST(date_trunc('month', date) AS DATE) AS period, {comp(1, 20)} AS ret20, row_number() OVER (PARTITION BY entity ORDER BY date) AS own FROM su),
a1 AS (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY date DESC) AS back FROM a0 WHERE own >= 20 AND ret20 IS NOT NULL),
a2 AS (SELECT * EXCLUDE (back) FROM a1 WHERE back = 1 AND date >= DATE '1994-01-01' AND date = (SELECT max(x.date) FROM su x WHERE x.entity = a1.entity AND date_trunc('month', x.date) = a1.period)),
u AS (SELECT pos.entity, a2.period AS date, a2.ret20 AS ret, a2.cap, pos.rule_id, CAST(pos.pos AS DOUBLE) AS signal FROM pos JOIN a2 ON pos.entity = a2.entity AND pos.date = a2.date),
""" + _RULE_HL[_RULE_HL.index("u0 AS") :] + """,
scan AS (SELECT rule_id, v.scheme, r.n_periods, r.ann_ret, r.ann_risk, r.sharpe FROM (VALUES """ + ", ".join(f"({r.rule_id})" for r in _chosen()) + """) AS i(rule_id) CROSS JOIN (VALUES ('equal'), ('float'), ('total')) AS v(scheme)
  LEFT JOIN (SELECT rule_id, scheme, count(hl) AS n_periods, CASE WHEN count(hl) > 1 THEN avg(hl) * 12.0 END AS ann_ret, stddev_samp(hl) * sqrt(12.0) AS ann_risk, avg(hl) * 12.0 / nullif(stddev_samp(hl) * sqrt(12.0), 0) AS sharpe FROM rhl WHERE hl IS NOT NULL GROUP BY 1, 2) r USING (rule_id, scheme))"""


def _scan(spark, sf):
    from .pipelines import rule_scan, rule_universe

    su = su_daily(spark, sf)
    return rule_scan(su, _chosen(), 20, 5, rule_universe(su, 20, "1994-01-01"))


@query(sql("su", "SELECT CAST(rule_id AS INTEGER) AS rule_id, scheme, coalesce(n_periods, 0) AS n_periods, round(ann_ret, 6) AS ann_ret, round(ann_risk, 6) AS ann_risk, round(sharpe, 6) AS sharpe FROM scan", _SCAN))
def rule_scan_native(spark, sf):
    """A few rules that SQL knows too, through the same matrix as all of them, ranked on a universe."""
    return rounded(_scan(spark, sf), "ann_ret", "ann_risk", "sharpe")


@query(sql("su", """SELECT scheme, bin, count(*) AS n, round(lo + (bin - 1) * (hi - lo) / 10, 6) AS left, round(lo + bin * (hi - lo) / 10, 6) AS right, round(least(lo, 1.0) - pad, 6) AS x_lo, round(greatest(hi, 1.0) + pad, 6) AS x_hi
FROM (SELECT *, CAST(least(10, floor((sharpe - lo) * 10 / (hi - lo)) + 1) AS INTEGER) AS bin, 0.05 * (greatest(hi, 1.0) - least(lo, 1.0)) AS pad
  FROM scan JOIN (SELECT scheme, min(sharpe) AS lo, max(sharpe) AS hi FROM scan GROUP BY scheme) USING (scheme) WHERE sharpe IS NOT NULL) GROUP BY scheme, bin, lo, hi, pad""", _SCAN))
def sharpe_histogram(spark, sf):
    """Sharpe ratios of those rules in ten bins by scheme, on axes that take in a reference of 1."""
    return rounded(portfolio.sharpe_distribution(_scan(spark, sf), 10, 1.0), "left", "right", "x_lo", "x_hi")


#: Counted from the published grids, apart from the code: numbers of values, pairs of averages, and filters whose unwind is smaller.
_MANIFEST = """
WITH x(v) AS (VALUES (0.005), (0.01), (0.015), (0.02), (0.025), (0.03), (0.035), (0.04), (0.045), (0.05), (0.06), (0.07), (0.08), (0.09), (0.10), (0.12), (0.14), (0.16), (0.18), (0.20), (0.25), (0.30), (0.40), (0.50)),
y(v) AS (VALUES (0.005), (0.01), (0.015), (0.02), (0.025), (0.03), (0.04), (0.05), (0.075), (0.10), (0.15), (0.20)),
fr AS (SELECT (SELECT count(*) FROM x) * (1 + 4 + 8) + (SELECT count(*) FROM x, y WHERE y.v < x.v) AS n),
pairs AS (SELECT count(*) AS n FROM range(15) a(i), range(15) b(j) WHERE i < j),
averages AS (SELECT n * (1 + 8 + 4 + 5) + 15 * (1 + 4 + 5) AS n FROM pairs)
SELECT 'FR' AS family, n::BIGINT AS n FROM fr UNION ALL SELECT 'MA', (n + 9)::BIGINT FROM averages UNION ALL SELECT 'OBV', n::BIGINT FROM averages
UNION ALL SELECT 'SR', ((10 + 8) * (1 + 8 + 4 + 4 + 8 * 4 + 4 * 4) + 10 * 5)::BIGINT UNION ALL SELECT 'CB', (10 * 17 * (1 + 8 + 3))::BIGINT"""


@query(_MANIFEST)
def manifest_counts(spark, sf):
    return rules.manifest_frame(spark).groupBy("family").agg(F.count("*").alias("n"))


# --- regressions and reports -----------------------------------------------------------------------------------------


@query(sql("panel", "SELECT date, n, round(c / nullif(v, 0), 6) AS slope, round(my - c / nullif(v, 0) * mx, 6) AS intercept FROM (SELECT date, count(*) AS n, avg(ret) AS my, avg(signal) AS mx, covar_samp(ret, signal) AS c, var_samp(signal) AS v FROM panel GROUP BY date) WHERE n >= 30"))
def trend_score_k1(spark, sf):
    return rounded(regress.slope_by_date(panel(spark, sf), "ret", "signal"), "slope", "intercept")


@query(sql("month", "SELECT sum(CASE WHEN y = 1 THEN ln(greatest(least(p, 1 - 1e-12), 1e-12)) ELSE ln(1 - greatest(least(p, 1 - 1e-12), 1e-12)) END)::DECIMAL(18,4)::DOUBLE AS ll, count(*) AS n FROM (SELECT CASE WHEN ret > 0 THEN 1 ELSE 0 END AS y, 1 / (1 + exp(-(close - open) / close)) AS p FROM mo WHERE ret IS NOT NULL)"))
def bernoulli_likelihood(spark, sf):
    mo = period_panel(su_daily(spark, sf), "month").dropna(subset=["ret"])
    d = mo.select(F.lit(1).alias("k"), xsection.binary_target(F.col("ret")).alias("y"), (1 / (1 + F.exp(-(F.col("close") - F.col("open")) / F.col("close")))).alias("p"))
    return stats.log_likelihood("y", "p", ["k"], d).select(F.round("ll", 4).alias("ll"), "n")


def _months(spark, sf):
    su = signals.trend_signals(su_daily(spark, sf)).withColumn("ret_ahead", compounded("ret", 1, 5))
    ma = [f"ma{n}" for n in signals.MA_LENGTHS]
    month = F.to_date(F.date_trunc("month", "date"))
    last = su.withColumn("month", month).groupBy("entity", "month").agg(F.max_by(F.struct("ret_ahead", "rev_week", "rev_month", *ma), "date").alias("x"))
    return last.select("entity", F.col("month").alias("date"), "x.*"), ma


@query()
def trend_score_ma(spark, sf):
    d, ma = _months(spark, sf)
    return regress.trend_scores(d, ma).select("entity", "date", "trend_score")


@query()
def fama_macbeth_logit(spark, sf):
    d, ma = _months(spark, sf)
    d = d.withColumns({c: xsection.percentile_rank(c) for c in ("rev_week", "rev_month")}).withColumn("y", xsection.binary_target(F.col("ret_ahead")))
    return regress.fama_macbeth(d, "y", ["rev_week", "rev_month"])


@query()
def pooled_logit_fit(spark, sf):
    d, ma = _months(spark, sf)
    return regress.pooled_fit(d.withColumn("y", xsection.binary_target(F.col("ret_ahead"))), "y", ["rev_week", "rev_month"])


@query()
def out_of_sample_logit(spark, sf):
    d, ma = _months(spark, sf)
    d = d.withColumn("y", xsection.binary_target(F.col("ret_ahead")))
    train, test = d.where("date < date'1996-01-01'"), d.where("date >= date'1996-01-01'")
    return regress.out_of_sample_fit(test, portfolio.positive_rate(train, "y"), "y", ["rev_week", "rev_month"])


def _cumulative():
    return """k AS (SELECT scheme, date, raw, sum(CASE WHEN raw > -1 THEN ln(1 + raw) END) OVER (PARTITION BY scheme ORDER BY date) AS cum, raw * 0.02 / nullif(stddev_samp(raw) OVER (PARTITION BY scheme), 0) AS scaled FROM hl),
k1 AS (SELECT *, sum(CASE WHEN scaled > -1 THEN ln(1 + scaled) END) OVER (PARTITION BY scheme ORDER BY date) AS cum_scaled FROM k)"""


@query(sql("hl", "SELECT scheme, date, round(cum, 6) AS cum, round(cum_scaled, 6) AS cum_scaled FROM k1", _cumulative()))
def cum_log_voladj(spark, sf):
    hl = portfolio.high_minus_low(portfolio.portfolio_returns(weights(spark, sf)), GROUPS)
    d = signals.vol_scaled(hl, "raw", ["scheme"], 0.02)
    d = d.withColumns({"cum": signals.cumulative_log_return(d, "raw", ["scheme"]), "cum_scaled": signals.cumulative_log_return(d, "raw_scaled", ["scheme"])})
    return rounded(d.select("scheme", "date", "cum", "cum_scaled"), "cum", "cum_scaled")


@query(sql("perf", "SELECT scheme, grp, round(value / 52 / 0.25 * 100, 4) AS monthly FROM perf WHERE metric = 'turnover'"))
def monthly_turnover_pct(spark, sf):
    t = _perf(spark, sf).where("metric = 'turnover'")
    return t.select("scheme", "grp", F.round(report.monthly_turnover(F.col("value"), 5), 4).alias("monthly"))


@query(sql("perf", "SELECT scheme, grp, printf('D%02d', grp) AS label, value FROM perf WHERE metric = 'ann_ret' AND grp <> 0"))
def decile_curve(spark, sf):
    return report.decile_curve(_perf(spark, sf))


def _models(spark, sf) -> DataFrame:
    """Two models on one panel: the day's return, and its range over its close."""
    ev = ev_daily(spark, sf)
    by = Window.partitionBy("entity").orderBy("date")
    d = ev.select("entity", "date", "cap", F.lead("ret").over(by).alias("ahead"), F.array(F.struct(F.lit("return").alias("model"), F.col("ret").alias("signal")), F.struct(F.lit("range").alias("model"), safe_div(F.col("high") - F.col("low"), "close").alias("signal"))).alias("m"))
    return d.select("entity", "date", "cap", F.col("ahead").alias("ret"), F.explode("m").alias("m")).select("entity", "date", "cap", "ret", "m.*").dropna(subset=["signal", "ret"])


_MODELS = """
m0 AS (SELECT *, lead(ret) OVER (PARTITION BY entity ORDER BY date) AS ahead FROM ev),
src AS (SELECT * FROM (SELECT 'return' AS model, entity, date, ret AS signal, ahead AS ret, cap FROM m0 UNION ALL SELECT 'range', entity, date, (high - low) / nullif(close, 0), ahead, cap FROM m0) WHERE signal IS NOT NULL AND ret IS NOT NULL),"""


def _model_perf(spark, sf, groups: int = GROUPS, ppy: int = 52) -> DataFrame:
    return portfolio.backtest(_models(spark, sf), groups, ppy, keys=("model",), thin="drop")


def _on_models(body: str) -> str:
    ctes, perf = backtest_sql("src", GROUPS, 52, ("model",))
    return sql("ev", body, _MODELS + ctes + f",\nbt AS ({perf})")


@query(_on_models("""SELECT p.model, p.scheme, CAST(o.place AS INTEGER) AS place, o.name AS row, p.value FROM bt p JOIN (VALUES (0, 'ret', 'ann_ret', 0), (1, 'ir', 'info_ratio', 0), (2, 'max_dd', 'max_dd', 0), (3, 'to', 'turnover', 0), (4, 'd_low', 'ann_ret', 1), (5, 'd_high', 'ann_ret', 5)) AS o(place, name, metric, grp)
ON p.metric = o.metric AND p.grp = o.grp"""))
def overview(spark, sf):
    return report.overview(_model_perf(spark, sf), GROUPS, ("model",))


@query(_on_models("SELECT CASE model WHEN 'return' THEN 'direct' ELSE 'retrained' END AS source, scheme, metric, value FROM bt WHERE grp = 0 AND metric IN ('ann_ret', 'sharpe', 'turnover')"))
def transfer_compare(spark, sf):
    """A signal that was made elsewhere, and one of the market's own, side by side."""
    p = _model_perf(spark, sf)
    of = lambda name: p.where(F.col("model") == name)
    return report.compare({"direct": of("return"), "retrained": of("range")})


_TWO = ("src AS (SELECT 1 AS horizon, entity, date, signal, ret, cap FROM panel UNION ALL SELECT 2, s.entity, s.date, s.signal, r.ret, s.cap FROM panel s JOIN c a ON s.date = a.date JOIN c b ON b.ord = a.ord + 1 JOIN panel r ON r.entity = s.entity AND r.date = b.date),")


def _two_horizons() -> str:
    ctes, perf = backtest_sql("src", GROUPS, 52, ("horizon",))
    return sql("panel", "SELECT horizon, scheme, CASE WHEN grp = 0 THEN 'DH' ELSE printf('D%02d', grp) END AS label, metric, value FROM bt WHERE metric IN ('ann_ret', 'sharpe') AND (horizon = 1 OR grp = 0)",
               "c AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM panel)),\n" + _TWO + ctes + f",\nbt AS ({perf})")


@query(_two_horizons())
def portfolio_table(spark, sf):
    """All groups of the first holding period, and high minus low of the second."""
    d = panel(spark, sf).select("entity", "date", "signal", "ret", "cap")
    both = d.withColumn("horizon", F.lit(1)).unionByName(asof.eval_horizon(d, 2).withColumn("horizon", F.lit(2)).select("entity", "date", "signal", "ret", "cap", "horizon"))
    p = portfolio.backtest(both, GROUPS, 52, keys=("horizon",), thin="drop")
    return report.portfolio_table({h: p.where(F.col("horizon") == h) for h in (1, 2)})


def _two_caps() -> str:
    ctes, perf = backtest_sql("src", GROUPS, 12)
    ctes = ctes.replace("CASE WHEN v.scheme = 'equal' THEN 1.0 WHEN cap > 0 THEN cap END AS w", "CASE WHEN v.scheme = 'equal' THEN 1.0 WHEN v.scheme = 'float' AND fcap > 0 THEN fcap WHEN v.scheme = 'total' AND cap > 0 THEN cap END AS w")
    ctes = ctes.replace("WHERE v.scheme = 'equal' OR cap > 0)", "WHERE v.scheme = 'equal' OR (v.scheme = 'float' AND fcap > 0) OR (v.scheme = 'total' AND cap > 0))")
    return sql("", perf, """
caps AS (SELECT l_suppkey AS entity, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS cap,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS fcap, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS vol FROM lineitem GROUP BY 1, 2),
src AS (SELECT entity, date, cap, fcap, vol AS signal, lead(cap / vol) OVER w / (cap / vol) - 1 AS ret FROM caps WINDOW w AS (PARTITION BY entity ORDER BY date)),""" + ctes)


@query(_two_caps())
def two_caps_backtest(spark, sf):
    """Float and total caps that differ: what was not returned, and everything, by supplier and month."""
    cents = lambda c: F.sum(c.cast("decimal(18,2)")).cast("double")
    price = F.col("l_extendedprice")
    d = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date")).agg(
        cents(price).alias("cap"), cents(F.when(F.col("l_returnflag") == "N", price).otherwise(0)).alias("fcap"), cents(F.col("l_quantity")).alias("signal"))
    level = F.col("cap") / F.col("signal")
    d = d.withColumn("ret", F.lead(level).over(Window.partitionBy("entity").orderBy("date")) / level - 1)
    return portfolio.backtest(d, GROUPS, 12, thin="drop", float_cap="fcap", total_cap="cap")


_ETF = """
pr0 AS (SELECT date, mkt_ret, exp(sum(CASE WHEN mkt_ret > -1 THEN ln(1 + mkt_ret) END) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) - 1 AS hold, count(mkt_ret) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS n FROM mkt),
pr1 AS (SELECT date, hold FROM pr0 WHERE n = 5), pr2 AS (SELECT stddev_samp(hold) AS vol FROM pr1),
pr3 AS (SELECT scheme, date, raw, raw * (SELECT vol FROM pr2) / nullif(stddev_samp(raw) OVER (PARTITION BY scheme), 0) AS scaled FROM hl UNION ALL SELECT 'series', date, hold, hold FROM pr1)"""


@query(sql("mkt hl", "SELECT scheme, date, round(sum(CASE WHEN raw > -1 THEN ln(1 + raw) END) OVER w, 6) AS cum, round(sum(CASE WHEN scaled > -1 THEN ln(1 + scaled) END) OVER w, 6) AS cum_scaled FROM pr3 WINDOW w AS (PARTITION BY scheme ORDER BY date)", _ETF))
def cumulative_with_series(spark, sf):
    """Cumulated high minus low beside a price series held over the same horizon, scaled to that series' volatility."""
    held = signals.holding_returns(xsection.market_return(su_daily(spark, sf)).select(F.lit("series").alias("entity"), "date", F.col("mkt_ret").alias("ret")), 5)
    vol = F.broadcast(held.agg(F.stddev_samp("hold_ret").alias("__vol")))
    hl = portfolio.high_minus_low(portfolio.portfolio_returns(weights(spark, sf)), GROUPS).crossJoin(vol)
    d = signals.vol_scaled(hl, "raw", ["scheme"], F.col("__vol")).select("scheme", "date", "raw", "raw_scaled")
    d = d.unionByName(held.select(F.col("entity").alias("scheme"), "date", F.col("hold_ret").alias("raw"), F.col("hold_ret").alias("raw_scaled")))
    d = d.withColumns({"cum": signals.cumulative_log_return(d, "raw", ["scheme"]), "cum_scaled": signals.cumulative_log_return(d, "raw_scaled", ["scheme"])})
    return rounded(d.select("scheme", "date", "cum", "cum_scaled"), "cum", "cum_scaled")


@query(sql("hl", f"SELECT scheme, cell, CAST(regexp_extract(cell, '^([-+]?\\d*\\.?\\d+)(\\**)$', 1) AS DOUBLE) AS number, regexp_extract(cell, '^([-+]?\\d*\\.?\\d+)(\\**)$', 2) AS marks FROM (SELECT scheme, printf('%.2f', t) || {_STARS} AS cell FROM q3)", _NW))
def report_cells(spark, sf):
    port = portfolio.portfolio_returns(weights(spark, sf))
    t = stats.mean_t(portfolio.high_minus_low(port, GROUPS), "raw", ["scheme"]).select("scheme", stats.cell(F.col("t"), F.col("t")).alias("cell"))
    number, marks = report.parsed_cell(F.col("cell"))
    return t.select("scheme", "cell", number.alias("number"), marks.alias("marks"))


_BT, _BT_BODY = backtest_sql("panel", GROUPS, 52)


@query(sql("panel", _BT_BODY, _BT))
def backtest_with_t(spark, sf):
    return portfolio.backtest(panel(spark, sf), GROUPS, thin="drop")


