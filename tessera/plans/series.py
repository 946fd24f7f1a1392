"""Queries on calendars, sources, universes and time series."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.expr import by_entity, compounded, rolling
from ..operators import asof, calendar, raster, signals, universe
from ..operators.xsection import market_return
from ..sources import io
from ..sources.panels import ev_daily, period_panel, su_daily, table
from .sqlkit import comp, frame, roll, sql

Q: dict = {}
S: dict = {}


def query(sql_text: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql_text is not None:
            S[f.__name__] = sql_text
        return f

    return add


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(sql("cal", "SELECT date, ord FROM cal"))
def market_calendar(spark, sf):
    return calendar.market_calendar(su_daily(spark, sf))


def _ends(unit):
    return sql("cal", f"SELECT period, date FROM (SELECT CAST(date_trunc('{unit}', date) AS DATE) AS period, max(date) AS date FROM cal GROUP BY 1) WHERE date BETWEEN DATE '1993-01-01' AND DATE '1997-06-30'")


@query(_ends("week"))
def as_of_week(spark, sf):
    return calendar.period_ends(calendar.market_calendar(su_daily(spark, sf)), "week", "1993-01-01", "1997-06-30")


@query(_ends("month"))
def as_of_month(spark, sf):
    return calendar.period_ends(calendar.market_calendar(su_daily(spark, sf)), "month", "1993-01-01", "1997-06-30")


@query(_ends("quarter"))
def as_of_quarter(spark, sf):
    return calendar.period_ends(calendar.market_calendar(su_daily(spark, sf)), "quarter", "1993-01-01", "1997-06-30")


_WINDOW = """SELECT a.date AS as_of, CAST(c.ord - a.ord AS INTEGER) AS step, c.date FROM cal a JOIN cal c ON c.ord BETWEEN a.ord + {lo} AND a.ord + {hi}
WHERE a.date IN (SELECT max(date) FROM cal GROUP BY date_trunc('quarter', date)) AND a.ord + {lo} >= 1 AND a.ord + {hi} <= (SELECT max(ord) FROM cal)"""


@query(sql("cal", _WINDOW.format(lo=-9, hi=0)))
def calendar_window_n(spark, sf):
    cal = calendar.market_calendar(su_daily(spark, sf))
    return calendar.window_dates(cal, calendar.period_ends(cal, "quarter"), 10, strict=False)


@query(sql("cal", _WINDOW.format(lo=1, hi=5)))
def calendar_forward_n(spark, sf):
    cal = calendar.market_calendar(su_daily(spark, sf))
    return calendar.window_dates(cal, calendar.period_ends(cal, "quarter"), 5, forward=True, strict=False)


@query(sql("cal", "SELECT date, lag(date) OVER (ORDER BY date) AS previous, lead(date) OVER (ORDER BY date) AS following FROM (SELECT max(date) AS date FROM cal GROUP BY date_trunc('week', date))"))
def rebalance_neighbours(spark, sf):
    return calendar.neighbours(calendar.period_ends(calendar.market_calendar(su_daily(spark, sf)), "week"))


@query(sql("ev", "SELECT entity, date, CAST(dense_rank() OVER (ORDER BY date) AS BIGINT) AS date_rank, CAST(year(date) AS INTEGER) AS year FROM ev"))
def date_rank(spark, sf):
    return calendar.with_year(calendar.with_date_rank(ev_daily(spark, sf))).select("entity", "date", "date_rank", "year")


@query(sql("su", "SELECT entity, CAST(date_trunc('week', date) AS DATE) AS week, round(exp(sum(CASE WHEN ret > -1 THEN ln(1 + ret) END)) - 1, 6) AS week_ret, round(stddev_samp(ret) * sqrt(252.0), 6) AS ann_vol, count(ret) AS n_days FROM su GROUP BY 1, 2"))
def weekly_resample(spark, sf):
    return rounded(calendar.weekly_summary(su_daily(spark, sf)), "week_ret", "ann_vol")


@query("SELECT user_id AS entity, CAST(ts AS DATE) AS date, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1, 2")
def read_dedupe_last(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("date"), "ts", "event_id", "value")
    return io.keep_last(e, ["entity", "date"], [F.col("ts"), F.col("event_id")]).select("entity", "date", "event_id", "value")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey = 7")
def read_entity(spark, sf):
    return io.read_entity(table(spark, sf, "lineitem"), 7, "l_suppkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query(sql("su", "SELECT s.entity, s.date, s.cap FROM su s JOIN (SELECT min(entity) AS entity FROM su) m ON s.entity = m.entity WHERE s.date = (SELECT max(date) FROM su WHERE entity = (SELECT min(entity) FROM su))"))
def point_lookup(spark, sf):
    su = su_daily(spark, sf).select("entity", "date", "cap")
    first = su.agg(F.min_by(F.struct("entity", "date"), F.struct("entity", (-F.unix_date("date")).alias("d"))).alias("k"))
    return su.join(F.broadcast(first.select("k.*")), ["entity", "date"], "left_semi")


@query("SELECT DISTINCT l_suppkey AS entity FROM lineitem")
def entity_list(spark, sf):
    return io.entities(table(spark, sf, "lineitem"), "l_suppkey").withColumnRenamed("l_suppkey", "entity")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return io.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("""WITH a AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(coalesce(a.y, b.y) AS INTEGER) AS y, coalesce(a.n, 0) AS n_parts, coalesce(b.n, 0) AS n_labels, coalesce(a.n, 0) = coalesce(b.n, 0) AS agree FROM a FULL JOIN b ON a.y = b.y""")
def shard_reconcile(spark, sf):
    return io.reconcile(table(spark, sf, "orders").select(F.year("o_orderdate").alias("y")), table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y")), "y")


@query(sql("su", "SELECT entity, date, close, round(" + roll("stddev_samp", "ret", -20, 0) + ", 6) AS volatility FROM su"))
def append_columns(spark, sf):
    su = su_daily(spark, sf)
    extra = su.withColumn("volatility", F.round(signals.rolling_vol(), 6)).select("entity", "date", "volatility")
    return io.append_columns(su.select("entity", "date", "close"), extra)


_H = (5, 20, 60)


@query(sql("su", "SELECT entity, date, " + ", ".join(f"round({comp(1, h)}, 6) AS ret_{h}d, CASE WHEN {comp(1, h)} IS NULL THEN 2 WHEN {comp(1, h)} > 0 THEN 1 ELSE 0 END AS ret_{h}d_label" for h in _H) + " FROM su"))
def fwd_return_labels(spark, sf):
    d = signals.forward_returns(su_daily(spark, sf), _H)
    d = d.withColumns({f"ret_{h}d_label": signals.label(f"ret_{h}d") for h in _H})
    return rounded(d, *(f"ret_{h}d" for h in _H)).select("entity", "date", *(c for h in _H for c in (f"ret_{h}d", f"ret_{h}d_label")))


_EWMA = """
i0 AS (SELECT entity, date, ret, row_number() OVER (PARTITION BY entity ORDER BY date) - 1 AS i FROM su),
i1 AS (SELECT *, CASE WHEN ret IS NOT NULL THEN pow(1 / (1 - 2 / 61.0::DOUBLE), i) END AS w FROM i0),
i2 AS (SELECT *, sum(w) OVER p AS s0, sum(w * w) OVER p AS q, sum(w * ret) OVER p AS s1, sum(w * ret * ret) OVER p AS s2, count(ret) OVER p AS n FROM i1 WINDOW p AS (PARTITION BY entity ORDER BY date)),
i3 AS (SELECT *, CASE WHEN n >= 60 THEN sqrt(greatest((s2 / s0 - (s1 / s0) * (s1 / s0)) * s0 * s0 / (s0 * s0 - q), 0)) END AS vol FROM i2)"""


@query(sql("su", "SELECT entity, date, round(vol, 6) AS ewma_vol, round(CASE WHEN vol IS NOT NULL AND vol <> 0 THEN ret / vol ELSE 0 END, 5) AS ret_tstat FROM i3", _EWMA))
def ewma_vol(spark, sf):
    d = signals.ewma_vol(su_daily(spark, sf))
    return d.select("entity", "date", F.round("ewma_vol", 6).alias("ewma_vol"), F.round(signals.t_statistic(F.col("ret"), F.col("ewma_vol")), 5).alias("ret_tstat"))


def _one(name, expr, source="su"):
    return sql(source, f"SELECT entity, date, round({expr}, 6) AS {name} FROM {source}")


@query(_one("mom", comp(-272, -21)))
def momentum_252_21(spark, sf):
    return rounded(signals.trend_signals(su_daily(spark, sf)).select("entity", "date", "mom"), "mom")


@query(sql("su", f"SELECT entity, date, round(-({comp(-20, 0)}), 6) AS rev_month, round(-({comp(-4, 0)}), 6) AS rev_week, round({comp(-4, 0)}, 6) AS lag_week_ret FROM su"))
def reversal_21_5(spark, sf):
    return su_daily(spark, sf).select("entity", "date", F.round(signals.reversal(21), 6).alias("rev_month"), F.round(signals.reversal(5), 6).alias("rev_week"), F.round(signals.lag_week_return(), 6).alias("lag_week_ret"))


@query(_one("dist_high", f"close / nullif({roll('max', 'high', -251, 0)}, 0)"))
def dist_52wh(spark, sf):
    return signals.with_distance_to_high(su_daily(spark, sf)).select("entity", "date", F.round("dist_high", 6).alias("dist_high"))


@query(sql("su", "SELECT entity, date, " + ", ".join(f"round({roll('avg', 'close', 1 - n, 0)} / nullif(close, 0), 6) AS ma{n}" for n in signals.MA_LENGTHS) + " FROM su"))
def ma_ratios(spark, sf):
    ma = [f"ma{n}" for n in signals.MA_LENGTHS]
    return rounded(signals.trend_signals(su_daily(spark, sf)).select("entity", "date", *ma), *ma)


@query(sql("mkt", f"""SELECT entity, date, round(CASE WHEN count(ret) OVER {frame(-251, 0)} = 252 AND count(mkt_ret) OVER {frame(-251, 0)} = 252
  THEN covar_samp(ret, mkt_ret) OVER {frame(-251, 0)} / nullif(var_samp(mkt_ret) OVER {frame(-251, 0)}, 0) END, 6) AS beta FROM su LEFT JOIN mkt USING (date)"""))
def rolling_beta(spark, sf):
    su = su_daily(spark, sf)
    return signals.rolling_beta(su, market_return(su)).select("entity", "date", F.round("beta", 6).alias("beta"))


@query(_one("volatility", roll("stddev_samp", "ret", -20, 0)))
def rolling_vol(spark, sf):
    return su_daily(spark, sf).select("entity", "date", F.round(signals.rolling_vol(), 6).alias("volatility"))


@query(sql("ev", f"SELECT entity, date, round(close * vol, 6) AS dollar_vol, CAST({roll('sum', '(CASE WHEN vol IS NULL OR vol <= 2 THEN 1 ELSE 0 END)', -4, 0)} AS BIGINT) AS zero_trade FROM (SELECT * REPLACE (vol AS vol) FROM ev)"))
def zero_trade(spark, sf):
    ev = ev_daily(spark, sf)
    idle = ev.withColumn("vol", F.col("vol") - 2)  # days of up to two events count as idle, since none has fewer than one
    return idle.select("entity", "date", F.round(F.col("close") * (F.col("vol") + 2), 6).alias("dollar_vol"), signals.zero_trade(5).alias("zero_trade"))


@query(_one("illiquidity", f"1e6 * {roll('avg', '(abs(ret) / nullif(abs(close) * vol, 0))', -20, 0)}"))
def amihud(spark, sf):
    return su_daily(spark, sf).select("entity", "date", F.round(1e6 * signals.illiquidity(), 6).alias("illiquidity"))


@query(sql("su", f"SELECT entity, date, {roll('max', 'close', -20, -1)} AS hi, {roll('min', 'close', -20, -1)} AS lo, round({roll('avg', 'close', -19, 0)}, 6) AS ma FROM su"))
def rolling_extrema(spark, sf):
    return signals.with_previous_extremes(su_daily(spark, sf), {"hi": ("max", 20), "lo": ("min", 20)}).select("entity", "date", "hi", "lo", F.round(rolling(F.avg, "close", -19, 0), 6).alias("ma"))


_OBV = "ob AS (SELECT *, sum(CASE WHEN close >= pc THEN vol WHEN close < pc THEN -vol ELSE 0 END) OVER (PARTITION BY entity ORDER BY date) AS obv FROM (SELECT *, lag(close) OVER (PARTITION BY entity ORDER BY date) AS pc FROM su))"


@query(sql("su", "SELECT entity, date, obv FROM ob", _OBV))
def obv(spark, sf):
    return signals.on_balance_volume(su_daily(spark, sf)).select("entity", "date", "obv")


def _carried(raw_sql, source="su", extra=""):
    own = (extra + ",\n" if extra else "") + f"raw AS (SELECT entity, date, {raw_sql} AS raw FROM {source})"
    return sql("su", "SELECT entity, date, CAST(raw AS INTEGER) AS raw, CAST(coalesce(last_value(nullif(raw, 0) IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS pos FROM raw", own)


_HI, _LO = roll("max", "close", -20, -1), roll("min", "close", -20, -1)


@query(_carried(f"coalesce(CASE WHEN close < ({_LO}) * 0.99 THEN -1 WHEN close > ({_HI}) * 1.01 THEN 1 END, 0)"))
def breakout_signal(spark, sf):
    d = signals.with_previous_extremes(su_daily(spark, sf), {"hi": ("max", 20), "lo": ("min", 20)})
    d = d.withColumn("raw", F.coalesce(F.when(F.col("close") < F.col("lo") * 0.99, -1).when(F.col("close") > F.col("hi") * 1.01, 1), F.lit(0)))
    return d.select("entity", "date", "raw", signals.carried("raw").alias("pos"))


_MA5, _MA20 = roll("avg", "close", -4, 0), roll("avg", "close", -19, 0)


@query(sql("su", f"SELECT entity, date, CAST(CASE WHEN count(raw) OVER {frame(-2, 0)} = 3 AND min(raw) OVER {frame(-2, 0)} = 1 THEN 1 WHEN count(raw) OVER {frame(-2, 0)} = 3 AND max(raw) OVER {frame(-2, 0)} = -1 THEN -1 ELSE 0 END AS INTEGER) AS confirmed FROM raw",
           f"raw AS (SELECT entity, date, coalesce(CASE WHEN ({_MA5}) < ({_MA20}) THEN -1 WHEN ({_MA5}) > ({_MA20}) THEN 1 END, 0) AS raw FROM su)"))
def ma_cross_delay(spark, sf):
    d = su_daily(spark, sf).withColumns({"fast": rolling(F.avg, "close", -4, 0), "slow": rolling(F.avg, "close", -19, 0)})
    d = d.withColumn("raw", signals.threshold_cross(F.col("fast"), F.col("slow")))
    return d.select("entity", "date", signals.confirmed("raw", 3).alias("confirmed"))


@query(_carried(f"coalesce(CASE WHEN ({_HI}) <= ({_LO}) * 1.5 AND close < ({_LO}) THEN -1 WHEN ({_HI}) <= ({_LO}) * 1.5 AND close > ({_HI}) THEN 1 END, 0)"))
def channel_breakout(spark, sf):
    d = signals.with_previous_extremes(su_daily(spark, sf), {"hi": ("max", 20), "lo": ("min", 20)})
    channel = F.col("hi") <= F.col("lo") * 1.5
    d = d.withColumn("raw", F.coalesce(F.when(channel & (F.col("close") < F.col("lo")), -1).when(channel & (F.col("close") > F.col("hi")), 1), F.lit(0)))
    return d.select("entity", "date", "raw", signals.carried("raw").alias("pos"))


@query(sql("ev", f"SELECT entity, date, round(ret, 6) AS ret, round({comp(1, 3)}, 6) AS hold_ret FROM ev QUALIFY {comp(1, 3)} IS NOT NULL"))
def holding_returns(spark, sf):
    return rounded(signals.holding_returns(ev_daily(spark, sf), 3).select("entity", "date", "ret", "hold_ret"), "ret", "hold_ret")


@query(sql("ev", """SELECT entity, date, round(close, 6) AS close FROM k UNION ALL
SELECT a.entity, m.d, round((a.c + b.c) / 2, 6) FROM (SELECT entity, arg_max(close, date) AS c FROM k, m WHERE date < d GROUP BY 1) a JOIN (SELECT entity, arg_min(close, date) AS c FROM k, m WHERE date > d GROUP BY 1) b USING (entity), m""",
           "m AS (SELECT DATE '2024-01-10' AS d), k AS (SELECT ev.* FROM ev, m WHERE date <> d)"))
def fill_session(spark, sf):
    gap = ev_daily(spark, sf).where("date <> date'2024-01-10'")
    return rounded(signals.fill_session(gap, "2024-01-10", ("close",)), "close")


_CHAIN = """
c0 AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM ev),
c1 AS (SELECT *, CASE WHEN i > 1 THEN ret END AS r FROM c0),
c2 AS (SELECT *, coalesce(sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER (PARTITION BY entity ORDER BY date), 0) AS g, coalesce(max(CASE WHEN r <= -1 THEN 1 END) OVER (PARTITION BY entity ORDER BY date), 0) AS dead FROM c1),
c3 AS (SELECT *, CASE WHEN i = 1 AND close IS NOT NULL THEN 1.0 WHEN r IS NULL THEN NULL WHEN dead = 1 THEN 0.0 ELSE exp(g) END AS adj_close FROM c2)"""


@query(sql("ev", "SELECT entity, date, round(adj_close, 6) AS adj_close, round(abs(high) * (adj_close / nullif(abs(close), 0)), 6) AS adj_high, round(adj_close / nullif(lag(adj_close, 4) OVER (PARTITION BY entity ORDER BY date), 0), 6) AS rebased FROM c3", _CHAIN))
def chain_adjust(spark, sf):
    d = signals.rebased(signals.chain_adjusted(ev_daily(spark, sf)), 5)
    return rounded(d, "adj_close", "adj_high", "rebased").select("entity", "date", "adj_close", "adj_high", "rebased")


_LAGS = ("open", "high", "low", "close", "ma")
_F5 = frame(-4, 0)
_SCALED = f"""
l0 AS (SELECT *, {roll('avg', 'close', -4, 0)} AS ma FROM su),
l1 AS (SELECT *, count(close) OVER {_F5} = 5 AS whole, greatest({', '.join(f'max({c}) OVER {_F5}' for c in _LAGS)}) AS hi, least({', '.join(f'min({c}) OVER {_F5}' for c in _LAGS)}) AS lo, max(vol) OVER {_F5} AS v FROM l0),
l2 AS (SELECT *, CASE WHEN hi - lo = 0 THEN 1e-6 ELSE hi - lo END AS span FROM l1)"""


@query(sql("su", "SELECT entity, date, " + ", ".join(f"round(CASE WHEN whole THEN ({f'lag({c}, {k}) OVER (PARTITION BY entity ORDER BY date)' if k else c} - lo) / span END, 6) AS {c}_lag{k + 1}" for c in _LAGS for k in (0, 2, 4))
           + ", round(CASE WHEN whole THEN lag(vol, 1) OVER (PARTITION BY entity ORDER BY date) / nullif(v, 0) END, 6) AS vol_lag2 FROM l2", _SCALED))
def image_scaled_lags(spark, sf):
    names = [f"{c}_lag{k + 1}" for c in _LAGS for k in (0, 2, 4)] + ["vol_lag2"]
    return rounded(raster.scaled_lags(su_daily(spark, sf)), *names).select("entity", "date", *names)


def _row(v):
    return f"CAST(round_even((1 - greatest(least(({v} - lo) / CASE WHEN hi - lo = 0 THEN 1e-6 ELSE hi - lo END, 1.0), 0.0)) * 25, 0) AS INTEGER)"


@query(sql("su", f"SELECT entity, date, {_row('close')} AS close_row, {_row('open')} AS open_row FROM (SELECT *, max(high) OVER {_F5} AS hi, min(low) OVER {_F5} AS lo FROM su)"))
def price_rows(spark, sf):
    f = by_entity().rowsBetween(-4, 0)
    d = su_daily(spark, sf).withColumns({"hi": F.max("high").over(f), "lo": F.min("low").over(f)})
    return d.select("entity", "date", *(raster.price_row(F.col(c), F.col("lo"), F.col("hi"), 26).alias(f"{c}_row") for c in ("close", "open")))


# --- universes -------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END AS code, substr(CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 6 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END, 1, 3) IN ('000', '001') AS listed FROM part")
def code_prefix(spark, sf):
    d = table(spark, sf, "part").withColumn("code", universe.zero_padded(F.col("p_partkey")))
    return d.select("p_partkey", "code", universe.has_prefix(F.col("code"), ("000", "001")).alias("listed"))


@query("SELECT p_partkey, coalesce(regexp_matches(p_type, '(?i)steel|BRASS'), false) AS hit FROM part")
def regex_mask(spark, sf):
    return table(spark, sf, "part").select("p_partkey", universe.matches(F.col("p_type"), "(?i)steel|BRASS").alias("hit"))


@query("SELECT p_partkey, (p_size IN (1, 2, 3) OR contains(p_type, 'TIN')) AS excluded, NOT (p_size IN (1, 2, 3) OR contains(p_type, 'TIN') OR starts_with(p_brand, 'Brand#1')) AS eligible FROM part")
def industry_mask(spark, sf):
    industry = universe.in_industry(F.col("p_size").cast("string"), F.col("p_type"), ("1", "2", "3"), ("TIN",))
    return table(spark, sf, "part").select("p_partkey", industry.alias("excluded"), universe.eligible(industry, F.col("p_brand").startswith("Brand#1")).alias("eligible"))


def _members(spark, sf):
    su = su_daily(spark, sf)
    asia = table(spark, sf, "supplier").where("s_nationkey < 8").select(F.col("s_suppkey").alias("entity"))
    return su, su.join(asia, "entity", "left_semi").where("month(date) < 7").select("entity", "date")


_MEM = "mem AS (SELECT DISTINCT entity, date FROM su WHERE entity IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 8) AND month(date) < 7)"


@query(sql("su", "SELECT entity, date, cap FROM su SEMI JOIN mem USING (entity, date) WHERE cap > 20000", _MEM))
def universe_semi_join(spark, sf):
    su, members = _members(spark, sf)
    return universe.to_universe(su, members, F.col("cap") > 20000).select("entity", "date", "cap")


@query(sql("su", "SELECT entity, date, cap FROM su WHERE entity IN (SELECT entity FROM mem)", _MEM))
def ever_eligible(spark, sf):
    su, members = _members(spark, sf)
    return universe.ever_member(su, members).select("entity", "date", "cap")


@query(sql("su", f"SELECT entity, date, round({comp(-4, 0)}, 6) AS lag_week_ret FROM (SELECT su.* FROM su SEMI JOIN mem USING (entity, date))", _MEM))
def pit_restricted_features(spark, sf):
    su, members = _members(spark, sf)
    return universe.to_universe(su, members).select("entity", "date", F.round(signals.lag_week_return(), 6).alias("lag_week_ret"))


@query(sql("su", "SELECT entity, date, cap FROM su WHERE entity IN (SELECT DISTINCT entity FROM su ORDER BY entity LIMIT 5) AND ret IS NOT NULL AND cap > 0"))
def first_entities(spark, sf):
    su = universe.first_entities(su_daily(spark, sf), 5)
    return universe.without_missing(su, "ret").where(universe.positive("cap")).select("entity", "date", "cap")


@query(sql("month", "SELECT entity, period, cap, CAST(r AS INTEGER) AS cap_rank FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY cap DESC, entity) AS r FROM mo WHERE cap > 0) WHERE r <= 10"))
def top_n_by_cap(spark, sf):
    mo = period_panel(su_daily(spark, sf), "month").withColumn("date", F.col("period"))
    return universe.top_by_cap(mo, 10).select("entity", "period", "cap", "cap_rank")


@query(sql("su", f"SELECT entity, date, label FROM (SELECT entity, date, CASE WHEN {comp(1, 20)} IS NULL THEN 2 WHEN {comp(1, 20)} > 0 THEN 1 ELSE 0 END AS label FROM su) WHERE label IN (0, 1)"))
def valid_labels(spark, sf):
    d = su_daily(spark, sf).withColumn("label", signals.label(compounded("ret", 1, 20)))
    return universe.labelled(d, "label").select("entity", "date", "label")


@query(sql("su", "SELECT entity, date FROM (SELECT *, max(date) OVER (PARTITION BY entity) AS own, max(date) OVER () AS last_day, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM su) WHERE NOT (date = own AND date < last_day) AND i >= 20"))
def delist_and_history(spark, sf):
    return universe.with_history(universe.without_final_rows(su_daily(spark, sf)), 20).select("entity", "date")


# --- joins -----------------------------------------------------------------------------------------------------------


@query(sql("su", f"SELECT entity, date, round(1 / (1 + exp(-(close - open) / close)), 6) AS p_up, round(r, 6) AS ret_5d FROM (SELECT *, {comp(1, 5)} AS r FROM su) WHERE date >= DATE '1995-01-01'"))
def merge_predictions(spark, sf):
    su = su_daily(spark, sf)
    pred = su.select("entity", "date", (1 / (1 + F.exp(-(F.col("close") - F.col("open")) / F.col("close")))).alias("p_up"))
    labels = su.select("entity", "date", compounded("ret", 1, 5).alias("ret_5d"))
    return rounded(asof.merge_on_keys(pred, labels, "1995-01-01"), "p_up", "ret_5d")


def _lagged(k):
    return sql("ev", f"SELECT s.entity, s.date, s.cap, round(r.ret, 6) AS ret FROM ev s JOIN c a ON s.date = a.date JOIN c b ON b.ord = a.ord + {k} JOIN ev r ON r.entity = s.entity AND r.date = b.date",
               "c AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM ev))")


@query(_lagged(1))
def lag_return_h2(spark, sf):
    return rounded(asof.eval_horizon(ev_daily(spark, sf).select("entity", "date", "cap", "ret"), 2), "ret")


@query(_lagged(2))
def lag_return_h3(spark, sf):
    return rounded(asof.eval_horizon(ev_daily(spark, sf).select("entity", "date", "cap", "ret"), 3), "ret")


@query(sql("month cal", "SELECT m.entity, m.period AS month, s.date, round(s.close, 6) AS close FROM (SELECT DISTINCT entity, period, (SELECT max(date) FROM cal WHERE date_trunc('month', cal.date) = m0.period) AS at FROM mo m0) m LEFT JOIN su s ON s.entity = m.entity AND s.date = m.at"))
def pit_reindex(spark, sf):
    su = su_daily(spark, sf)
    ends = calendar.period_ends(calendar.market_calendar(su), "month").select(F.col("period").alias("month"), "date")
    grid = su.select("entity", F.to_date(F.date_trunc("month", "date")).alias("month")).distinct().join(ends, "month")
    out = asof.at_dates(grid, su.select("entity", "date", "close", F.lit(True).alias("there")))
    return out.select("entity", "month", F.when(F.col("there"), F.col("date")).alias("date"), F.round("close", 6).alias("close"))


@query(sql("ev", "SELECT e.entity, e.date, round(e.close, 6) AS close, round(p.p, 6) AS p_up FROM ev e ASOF LEFT JOIN (SELECT entity, max(date) AS date, arg_max(close, date) / 100 AS p FROM ev GROUP BY entity, date_trunc('week', date)) p ON e.entity = p.entity AND e.date >= p.date"))
def asof_join(spark, sf):
    ev = ev_daily(spark, sf)
    pred = period_panel(ev, "week").select("entity", "date", (F.col("close") / 100).alias("p_up"))
    return rounded(asof.as_of_join(ev.select("entity", "date", "close"), pred, "p_up"), "close", "p_up")


@query(sql("su", "SELECT entity, date, round((open / 7 + high / 7 + low / 7) / 3, 6) AS p_up FROM su WHERE cap > 20000 AND vol > 20"))
def ensemble_mean(spark, sf):
    su = su_daily(spark, sf)
    member = lambda c, keep: su.where(keep).select("entity", "date", (F.col(c) / 7).alias("p_up"))
    return rounded(asof.ensemble([member("open", "cap > 20000"), member("high", "vol > 20"), member("low", "true")]), "p_up")


@query(sql("mkt", "SELECT entity, date, round(ret - mkt_ret, 6) AS excess FROM su LEFT JOIN mkt USING (date)"))
def with_market(spark, sf):
    su = su_daily(spark, sf)
    return asof.with_market(su, market_return(su)).select("entity", "date", F.round(F.col("ret") - F.col("mkt_ret"), 6).alias("excess"))


