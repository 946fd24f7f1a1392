"""Queries on charts, predictions, characteristic tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import compounded
from ..operators import asof, calendar, model, portfolio, raster, regress, signals, stats, universe, xsection
from ..sources.panels import period_panel, su_daily, table
from .series import rounded
from .sqlkit import backtest_sql, comp, roll, sql

Q: dict = {}
S: dict = {}


def query(sql_text: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql_text is not None:
            S[f.__name__] = sql_text
        return f

    return add


def _charts(spark, sf, window=5, **how) -> DataFrame:
    return raster.charts(su_daily(spark, sf), calendar.own_last("month"), window, **how)


@query()
def chart_images(spark, sf):
    return _charts(spark, sf)


_BARS = """
w AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM su),
c0 AS (SELECT w.entity, w.date, w.i AS last FROM w JOIN (SELECT entity, max(date) AS date FROM su GROUP BY entity, date_trunc('month', date)) USING (entity, date) WHERE w.i >= 5),
c1 AS (SELECT c0.entity, c0.date, b.i - c0.last + 4 AS k, b.open / f.close AS o, b.high / f.close AS h, b.low / f.close AS l, b.close / f.close AS c, b.vol FROM c0 JOIN w b ON b.entity = c0.entity AND b.i BETWEEN c0.last - 4 AND c0.last JOIN w f ON f.entity = c0.entity AND f.i = c0.last - 4),
c2 AS (SELECT *, min(least(o, h, l, c)) OVER chart AS lo, max(greatest(o, h, l, c)) OVER chart AS hi, max(vol) OVER chart AS most FROM c1 WINDOW chart AS (PARTITION BY entity, date)),
c3 AS (SELECT entity, date, k, greatest(1, round_even(vol / most * 5, 0)) AS tall, {rows} FROM c2),
bits AS (SELECT entity, date, y * 15 + 3 * k + x AS spot, CASE WHEN y >= 26 THEN x = 1 AND y >= 32 - tall WHEN x = 1 THEN y BETWEEN yh AND yl WHEN x = 0 THEN y = yo ELSE y = yc END AS bit FROM c3, range(0, 32) AS a(y), range(0, 3) AS b(x)),
digits AS (SELECT entity, date, spot // 4 AS d, sum(CASE WHEN bit THEN 8 >> CAST(spot % 4 AS INTEGER) ELSE 0 END) AS v FROM bits GROUP BY ALL)""".format(
    rows=", ".join(f"round_even(round_even((1 - ({c} - lo) / CASE WHEN hi = lo THEN 1e-6 ELSE hi - lo END) * 25, 9), 0) AS y{c}" for c in "ohlc"))


@query(sql("su", "SELECT entity, date, string_agg(substr('0123456789ABCDEF', CAST(v AS INTEGER) + 1, 1), '' ORDER BY d) AS image FROM digits GROUP BY entity, date", _BARS))
def chart_bars(spark, sf):
    """Charts of five sessions without the average's line, whose packed pixels SQL can draw too."""
    return _charts(spark, sf, average=False).select("entity", "date", F.hex("image").alias("image"))


@query()
def chart_images_20(spark, sf):
    return _charts(spark, sf, 20, counted=True).select("entity", "date", F.length("image").alias("n_bytes"), "n_set")


@query()
def chart_pixel_stats(spark, sf):
    return raster.pixel_stats(_charts(spark, sf, counted=True), 5)


@query()
def chart_scores(spark, sf):
    """Forward pass of a small network with fixed random weights; trained weights take their place."""
    return model.convolutional_scores(_charts(spark, sf), model.random_weights(5, filters=4), 5, 80.0, 110.0)


@query(sql("su", "SELECT entity, date, CASE WHEN CAST(('0x' || substr(md5('42|' || entity || '|' || date), 1, 8)) AS BIGINT) / 4294967296.0 < 0.7 THEN 'train' ELSE 'valid' END AS part FROM su WHERE date <= DATE '1997-12-31'"))
def sample_split(spark, sf):
    train, _ = model.time_split(su_daily(spark, sf), "1997-12-31", "1998-01-01")
    return model.md5_split(train).select("entity", "date", "part")


@query()
def stand_in_scores(spark, sf):
    from .pipelines import stand_in_predictions

    return stand_in_predictions(su_daily(spark, sf), "1997-12-31", "1998-01-01")


def month_end(spark, sf) -> DataFrame:
    """Characteristics at each entity's last session of a month, with size, forward return and a prediction as of then."""
    su = su_daily(spark, sf)
    d = signals.liquidity_panel(signals.trend_signals(su), xsection.market_return(su)).withColumn("ret_ahead", compounded("ret", 1, 5))
    d = d.withColumn("size", F.log(F.when(F.col("cap") > 0, F.col("cap"))))
    ends = period_panel(su, "month").select("entity", "date", "period")
    pred = period_panel(su, "week").select("entity", "date", (1 / (1 + F.exp(-(F.col("close") - F.col("open")) / F.col("close")))).alias("p_up"))
    return asof.as_of_join(asof.at_dates(ends, d.drop("period")), pred, "p_up")


@query(sql("month mkt", f"""SELECT m.entity, m.period, round(c.vol21, 6) AS volatility, round(c.dist, 6) AS dist_high, round(p.p_up, 6) AS p_up FROM mo m
LEFT JOIN (SELECT entity, date, {roll('stddev_samp', 'ret', -20, 0)} AS vol21, close / nullif({roll('max', 'high', -251, 0)}, 0) AS dist FROM su) c ON m.entity = c.entity AND m.date = c.date
ASOF LEFT JOIN (SELECT entity, max(date) AS date, arg_max(1 / (1 + exp(-(close - open) / close)), date) AS p_up FROM su GROUP BY entity, date_trunc('week', date)) p ON m.entity = p.entity AND m.date >= p.date"""))
def month_end_panel(spark, sf):
    return rounded(month_end(spark, sf), "volatility", "dist_high", "p_up").select("entity", "period", "volatility", "dist_high", "p_up")


def _backtest(needs: str, source: str, groups: int = 5, ppy: int = 12, keys: tuple[str, ...] = ()) -> str:
    ctes, body = backtest_sql("src", groups, ppy, keys)
    return sql(needs, body, source + "," + ctes)


def _ahead(panel: str, returns: str, lag: int, columns: str) -> str:
    """Rows of a panel with the return ``lag`` of its own dates later."""
    cal = f"(SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM {panel}))"
    return f"SELECT {columns}, r.ret FROM {panel} s JOIN {cal} a ON s.date = a.date JOIN {cal} b ON b.ord = a.ord + {lag} JOIN {returns} r ON r.entity = s.entity AND r.date = b.date"


@query(_backtest("month", f"""
md AS (SELECT entity, period AS date, cap, close, vol, ret FROM mo), base AS (SELECT * FROM md WHERE cap > 100),
lagged AS ({_ahead('base', 'md', 1, 's.entity, s.date, s.cap, s.close, s.vol')}),
src AS (SELECT 'close' AS factor, entity, date, close AS signal, ret, cap FROM lagged UNION ALL SELECT 'vol', entity, date, vol, ret, cap FROM lagged)""", keys=("factor",)))
def factor_backtest(spark, sf):
    """A generic factor panel: universe, caps at formation, next period's return, several signals in one plan."""
    mo = period_panel(su_daily(spark, sf), "month").withColumn("date", F.col("period"))
    base = universe.to_universe(mo, mo.where("cap > 100").select("entity", "date"), must=True)
    lagged = asof.lagged_return(base.select("entity", "date", "cap", "close", "vol", "ret"), mo.select("entity", "date", "ret"), 1)
    factors = F.explode(F.array(*(F.struct(F.lit(s).alias("factor"), F.col(s).alias("signal")) for s in ("close", "vol"))))
    return portfolio.backtest(lagged.select("entity", "date", "ret", "cap", factors.alias("x")).select("entity", "date", "ret", "cap", "x.*"), 5, 12, keys=("factor",), thin="drop")


@query(_backtest("month", f"""
top AS (SELECT entity, period AS date, ret, ret AS signal, cap FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY cap DESC, entity) AS r FROM mo WHERE cap > 0) WHERE r <= 50),
src AS ({_ahead('top', 'top', 1, 's.entity, s.date, s.signal, s.cap')})"""))
def top_n_backtest(spark, sf):
    mo = period_panel(su_daily(spark, sf), "month").withColumn("date", F.col("period"))
    d = universe.top_by_cap(mo, 50).withColumn("signal", F.col("ret"))
    return portfolio.backtest(asof.eval_horizon(d.select("entity", "date", "signal", "ret", "cap"), 2), 5, 12, thin="drop")


@query(sql("su", """SELECT period AS as_of, count(*) AS n FROM su JOIN (SELECT CAST(date_trunc('month', date) AS DATE) AS period, max(date) AS date FROM su GROUP BY 1) USING (date) GROUP BY 1"""))
def labels_at_dates(spark, sf):
    su = su_daily(spark, sf)
    ends = calendar.period_ends(calendar.market_calendar(su), "month")
    return su.select("entity", "date").join(F.broadcast(ends), "date").groupBy(F.col("period").alias("as_of")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS entity, date_trunc('day', ts) AS start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS vol FROM events GROUP BY 1, 2")
def stream_bars(spark, sf):
    """The streaming bars, run over the whole table as a batch."""
    from ..streaming.windows import bars

    return bars(table(spark, sf, "events")).drop("end")


@query()
def rule_scan(spark, sf):
    """All rules of the manifest."""
    from ..operators import rules
    from .pipelines import rule_scan as scan

    return scan(su_daily(spark, sf), rules.manifest(), 20, 5)


_BENCH = f"""
sig AS (SELECT entity, date, cap, {comp(1, 20)} AS ret, {comp(-272, -21)} AS mom, -({comp(-20, 0)}) AS rev_month, -({comp(-4, 0)}) AS rev_week FROM su),
ends AS (SELECT max(date) AS date FROM su GROUP BY date_trunc('month', date)), at0 AS (SELECT sig.* FROM sig SEMI JOIN ends USING (date)),
"""


def _bench_rows(name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS model, CAST({h} AS INTEGER) AS eval_horizon, entity, date, signal, ret, cap FROM ({_ahead('at0', 'at0', h - 1, f's.entity, s.date, s.{name} AS signal, s.cap')})" for h in (2, 3))


@query(_backtest("su", _BENCH + "src AS (" + " UNION ALL ".join(map(_bench_rows, ("mom", "rev_month", "rev_week"))) + ")", keys=("model", "eval_horizon")))
def benchmark_backtests(spark, sf):
    """Momentum and the reversals at month ends, for the second and the third holding period, in one plan."""
    from .pipelines import backtests, benchmark_signals

    return backtests(benchmark_signals(su_daily(spark, sf), 20, ("mom", "rev_month", "rev_week")), 20, 5, eval_horizons=(2, 3), thin="drop")


@query()
def trend_score_backtest(spark, sf):
    """The score of the moving averages, which a regression per date smooths, for its own holding period; at each name's
    last session of a month, since few names trade on the market's last one."""
    from .pipelines import backtests, benchmark_signals

    return backtests(benchmark_signals(su_daily(spark, sf), 20, ("trend_score",), own=True), 20, 5, thin="drop")


@query(_backtest("su", f"""
r0 AS (SELECT entity, date, cap, close, {comp(1, 5)} AS r5, {comp(1, 20)} AS r20 FROM su),
r1 AS (SELECT entity, CAST(date_trunc('month', date) AS DATE) AS period, max(date) AS date FROM su GROUP BY ALL),
r2 AS (SELECT r0.entity, r1.period AS date, cap, close AS signal, r5, r20 FROM r1 JOIN r0 ON r0.entity = r1.entity AND r0.date = r1.date),
src AS (SELECT 'price' AS model, 'first' AS days, entity, date, signal, r5 AS ret, cap FROM r2 UNION ALL SELECT 'price', 'later', entity, date, signal, CASE WHEN r5 > -1 THEN (1 + r20) / (1 + r5) - 1 END, cap FROM r2)""", keys=("model", "days")))
def holding_breakdown(spark, sf):
    from .pipelines import holding_breakdown as breakdown

    su = su_daily(spark, sf).withColumns({"r5": compounded("ret", 1, 5), "r20": compounded("ret", 1, 20), "period": F.to_date(F.date_trunc("month", "date"))})
    last = su.groupBy("entity", "period").agg(F.max_by(F.struct("r5", "r20", "cap", F.col("close").alias("signal")), "date").alias("x")).select("entity", F.col("period").alias("date"), "x.*")
    return breakdown({"price": last}, "r5", "r20", 5, thin="drop")


@query(sql("su", f"""SELECT entity, date, round(r5, 6) AS ret_5d, round(r20, 6) AS ret_20d, round(r5, 6) AS ret_week, round(r20, 6) AS ret_month, CASE WHEN r5 IS NULL THEN 2 WHEN r5 > 0 THEN 1 ELSE 0 END AS ret_5d_label,
CASE WHEN ret IS NULL THEN 2 WHEN ret > 0 THEN 1 ELSE 0 END AS ret_label FROM (SELECT *, {comp(1, 5)} AS r5, {comp(1, 20)} AS r20 FROM (SELECT su.* FROM su SEMI JOIN mem USING (entity, date)))""",
           "mem AS (SELECT DISTINCT entity, date FROM su WHERE cap > 20000)"))
def prepared_labels(spark, sf):
    """Daily labels of a universe's members, with the named horizons."""
    from .pipelines import prepare_labels

    su = su_daily(spark, sf)
    d = prepare_labels(su, su.where("cap > 20000").select("entity", "date"), horizons=(5, 20))
    return rounded(d.select("entity", "date", "ret_5d", "ret_20d", *(F.col(f"ret_{n}") for n in ("week", "month")), "ret_5d_label", "ret_label"), "ret_5d", "ret_20d", "ret_week", "ret_month")


def _labelled(w: int, h: int, unit: str, n_bytes: int) -> str:
    """Rows that have a chart of a window at a horizon's period ends, with their labels."""
    return f"""SELECT t.entity, t.date, {w} AS "window", {h} AS horizon, CAST(year(t.date) AS INTEGER) AS year, round(f.r{h}, 6) AS ret, CASE WHEN f.r{h} IS NULL THEN 2 WHEN f.r{h} > 0 THEN 1 ELSE 0 END AS label, {n_bytes} AS n_bytes
FROM t{w} t JOIN (SELECT max(date) AS date FROM t{w} GROUP BY date_trunc('{unit}', date)) USING (date) JOIN ahead f ON f.entity = t.entity AND f.date = t.date"""


_LABELLED = f"ahead AS (SELECT entity, date, row_number() OVER (PARTITION BY entity ORDER BY date) AS i, {comp(1, 5)} AS r5, {comp(1, 20)} AS r20, {comp(1, 60)} AS r60 FROM su)" + "".join(
    f""",
h{w} AS (SELECT entity, date, max(date) OVER (PARTITION BY entity) AS own_last, max(date) OVER () AS last FROM ahead WHERE i >= {w}),
t{w} AS (SELECT entity, date FROM h{w} WHERE NOT (date = own_last AND date < last))""" for w in (5, 20, 60))


@query(sql("su", " UNION ALL ".join(_labelled(w, h, unit, n) for w, n in ((5, 60), (20, 480), (60, 2160)) for h, unit in ((5, "week"), (20, "month"), (60, "quarter"))), _LABELLED))
def labelled_images(spark, sf):
    """Charts with labels for every window and sampling frequency."""
    from .pipelines import UNITS, labelled_charts

    d = labelled_charts(su_daily(spark, sf), [(w, h) for w in raster.LAYOUT for h in UNITS])
    return d.select("entity", "date", "window", "horizon", "year", F.round("ret", 6).alias("ret"), "label", F.length("image").alias("n_bytes"))


@query()
def image_predictions(spark, sf):
    """Mean scores of two networks with fixed weights on the test period's charts, pixel statistics from the training period."""
    from .pipelines import build_images, predictions

    images = build_images(su_daily(spark, sf), (5,), (20,), cross=True)[5, 20]
    return predictions(images, [model.random_weights(5, filters=4, seed=k) for k in (0, 1)], 5, "1996-12-31", "1997-01-01")
