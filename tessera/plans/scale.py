"""Queries on operators that serve tables of any size: ranks in ranges, interval joins, bucketed tables, stores, streams,
table functions, mergeable counts, and sequential rules with their twins in recursive SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions.expr import compounded, rolling
from ..operators import asof, counts, rule_function, rules, xsection
from ..sources import io, store
from ..sources.panels import period_panel, su_daily, table
from ..streaming import stateful
from .portfolios import _chosen, _rule_sql
from .series import rounded
from .sqlkit import comp, roll, sql

Q: dict = {}
S: dict = {}


def query(sql_text: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql_text is not None:
            S[f.__name__] = sql_text
        return f

    return add


@query(sql("su", """SELECT entity, date, CASE WHEN ret IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY ret NULLS LAST) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2 END AS rank,
CASE WHEN ret IS NOT NULL THEN count(ret) OVER (PARTITION BY date) END AS rank_of FROM su"""))
def rank_in_ranges(spark, sf):
    """Average ranks per date, where no date's names meet in one task."""
    return xsection.ranked_in_ranges(su_daily(spark, sf), "ret").select("entity", "date", "rank", "rank_of")


_SPANS = """spans AS (SELECT entity, CAST(date_trunc('year', date) AS DATE) + CAST(entity % 60 AS INTEGER) AS since, CASE WHEN entity % 5 = 0 THEN NULL ELSE CAST(date_trunc('year', date) AS DATE) + CAST(entity % 60 + 90 AS INTEGER) END AS until, max(cap) AS top
  FROM su GROUP BY 1, 2, 3)"""


@query(sql("su", "SELECT s.entity, s.date, m.since, m.top FROM su s JOIN spans m ON s.entity = m.entity AND s.date >= m.since AND s.date <= coalesce(m.until, DATE '9999-12-31')", _SPANS))
def interval_membership(spark, sf):
    """Sessions inside an entity's spans of membership, some of them open."""
    su = su_daily(spark, sf)
    start = F.date_add(F.to_date(F.date_trunc("year", "date")), (F.col("entity") % 60).cast("int"))
    spans = su.groupBy("entity", start.alias("since")).agg(F.max("cap").alias("top")).withColumn("until", F.when(F.col("entity") % 5 != 0, F.date_add("since", 90)))
    return asof.range_join(su.select("entity", "date"), spans, ("entity",)).select("entity", "date", "since", "top")


@query(sql("su", f"SELECT entity, date, round({comp(1, 5)}, 6) AS ret_5d, round({roll('avg', 'close', -19, 0)}, 6) AS ma20 FROM su"))
def bucketed_windows(spark, sf):
    """Windows over a table bucketed by entity: once it is written, no query of an entity's history shuffles it."""
    name = f"tessera_su_{hashlib.md5(sf.encode()).hexdigest()[:12]}"
    io.write_bucketed(su_daily(spark, sf), name, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = spark.table(name).select("entity", "date", compounded("ret", 1, 5).alias("ret_5d"), rolling(F.avg, "close", -19, 0).alias("ma20"))
    return rounded(own, "ret_5d", "ma20")


@query(sql("su", """SELECT month, count(*) AS n, round(sum(cap), 4) AS cap FROM (SELECT strftime(date, '%Y-%m') AS month, CASE WHEN date >= DATE '1997-01-01' THEN cap * 2 ELSE cap END AS cap FROM su) GROUP BY 1"""))
def incremental_months(spark, sf):
    """Monthly sums kept in a store: the first run makes the months before 1997; the second finds later ones, and changed
    inputs, and makes those only."""
    su = su_daily(spark, sf).withColumn("month", F.date_format("date", "yyyy-MM")).select("entity", "date", "month", "cap")
    kept = store.Store(spark, io.scratch(spark, "months"), "month")

    def run(inputs):
        kept.update(inputs, lambda keys: inputs.join(F.broadcast(keys), "month", "left_semi").groupBy("month").agg(F.count("*").alias("n"), F.sum("cap").alias("cap")))

    run(su.where("date < '1997-07-01'"))
    run(su.withColumn("cap", F.when(F.col("date") >= "1997-01-01", F.col("cap") * 2).otherwise(F.col("cap"))))
    return kept.read().select("month", "n", F.round("cap", 4).alias("cap"))


@query(sql("su", "SELECT strftime(date, '%Y-%m') AS month FROM su EXCEPT SELECT strftime(date, '%Y-%m') FROM su WHERE cap > 20000 AND date < DATE '1997-01-01'"))
def pending_months(spark, sf):
    """Months of the panel that no earlier run has made: a set difference."""
    su = su_daily(spark, sf)
    month = F.date_format("date", "yyyy-MM").alias("month")
    return su.select(month).distinct().exceptAll(su.where("cap > 20000 AND date < '1997-01-01'").select(month).distinct())


_STREAM = """b AS (SELECT user_id AS entity, ts, value AS close, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS i FROM events),
o AS (SELECT *, lag(close) OVER (PARTITION BY entity ORDER BY i) AS last FROM b)"""


@query(sql("", "SELECT entity, ts, close, CAST(sum(CASE WHEN last IS NULL THEN 0 WHEN close >= last THEN 1 ELSE -1 END) OVER (PARTITION BY entity ORDER BY i) AS DOUBLE) AS obv FROM o QUALIFY ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY", _STREAM))
def stream_balance(spark, sf):
    """A stream over the events with an entity's state: the balance at each event that the watermark has passed."""
    path = io.scratch(spark, "balance")
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(_folder(spark, sf))
    bars = events.select(F.col("user_id").cast("long").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("close"), F.lit(1.0).alias("vol"))
    q = stateful.running(bars, "1 day").writeStream.outputMode("append").option("checkpointLocation", f"{path}-state").format("parquet").option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path).select("entity", F.col("ts").cast(table(spark, sf, "events").schema["ts"].dataType).alias("ts"), "close", "obv")


def _folder(spark, sf: str) -> str:
    """A folder with the events as files, as a stream reads them: the table itself if it is one, else a copy."""
    path = io.scratch(spark, "events")
    table(spark, sf, "events").write.parquet(path)
    return path


@query(sql("su", f"SELECT entity, date, rule_id, pos FROM pos WHERE rule_id = {_chosen()[1].rule_id}", _rule_sql()))
def rule_table_function(spark, sf):
    """A rule's daily positions by a table function in SQL."""
    rule_function.register(spark)
    su_daily(spark, sf).select(F.col("entity").cast("long").alias("entity"), "date", "close", "vol").createOrReplaceTempView("tessera_rule_panel")
    return spark.sql(f"SELECT entity, date, rule_id, pos FROM rule_positions(TABLE(tessera_rule_panel) PARTITION BY entity ORDER BY (date), {_chosen()[1].rule_id})")


@query(sql("month", "SELECT factor, scheme, CAST(grouping_id(factor, scheme) AS INTEGER) AS level, count(*) AS n FROM mo, (VALUES ('close'), ('vol')) AS f(factor), (VALUES ('equal'), ('float'), ('total')) AS s(scheme) WHERE scheme = 'equal' OR (cap > 20000 AND factor = 'vol') GROUP BY GROUPING SETS ((factor, scheme), (factor), (scheme))"))
def counts_by_model_and_scheme(spark, sf):
    """Rows by model, by scheme and by both, in one aggregation."""
    one = lambda *v: F.explode(F.array(*map(F.lit, v)))
    rows = period_panel(su_daily(spark, sf), "month").withColumn("factor", one("close", "vol")).withColumn("scheme", one("equal", "float", "total")).where("scheme = 'equal' OR (cap > 20000 AND factor = 'vol')")
    return counts.counts_by_sets(rows, [("factor", "scheme"), ("factor",), ("scheme",)])


@query(sql("su", "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n, count(DISTINCT entity) AS entities, count(DISTINCT date) AS dates, true AS near FROM su GROUP BY 1"))
def distinct_by_sketches(spark, sf):
    """Names and dates of a year from sketches of its months, beside the exact counts: near, if within four standard errors."""
    su = su_daily(spark, sf)
    stored = counts.sketches(su, [F.year("date").alias("year"), F.month("date").alias("month")], ("entity", "date"))
    about = counts.merged(stored, ["year"], ("entity", "date"))
    exact = su.groupBy(F.year("date").alias("year")).agg(F.count_distinct("entity").alias("entities"), F.count_distinct("date").alias("dates"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 4 * counts.relative_error() * F.col(b) + 0.5
    return about.join(exact, "year").select("year", "n", "entities", "dates", (near("n_entity", "entities") & near("n_date", "dates")).alias("near"))


# --- sequential rules, in SQL one session after the other ------------------------------------------------------------


def _pick(variant: str, **p) -> rules.Rule:
    return next(r for r in rules.manifest() if r.variant == variant and all(r.get(k) == v for k, v in p.items()))


def _sequence():
    return {"hold": _pick("cross_hold", short=5, long=20, c=10), "flip": _pick("simple", x=0.05), "neutral": _pick("neutral", x=0.1, y=0.05), "locked": _pick("hold", x=0.05, c=10), "stop": _pick("range_stop", n=20, stop=0.05)}


def _filter_sql(name: str, rule: rules.Rule) -> str:
    x, y, c = rule.get("x"), rule.get("y"), rule.get("c", 0)
    unwind, neutral, lock = (x if y is None else y), y is not None, max(c - 1, 0)
    return f"""
{name}(entity, i, pos, low, high, lock) AS (
  SELECT entity, 0::BIGINT, 0, close, close, 0 FROM px WHERE i = 1
  UNION ALL
  SELECT entity, i, CASE WHEN up THEN 1 WHEN down THEN -1 WHEN flat THEN 0 ELSE pos END, CASE WHEN down OR flat THEN close ELSE lo END, CASE WHEN up OR flat THEN close ELSE hi END, CASE WHEN up OR down THEN {lock} ELSE greatest(lock - 1, 0) END
  FROM (SELECT *, enter_long OR (leave_short AND NOT {neutral}) AS up, enter_short OR (leave_long AND NOT {neutral}) AS down, (leave_long OR leave_short) AND {neutral} AS flat
    FROM (SELECT *, lock = 0 AND pos = 0 AND close >= lo * (1 + {x}::DOUBLE) AS enter_long, lock = 0 AND pos = 0 AND NOT close >= lo * (1 + {x}::DOUBLE) AND close <= hi * (1 - {x}::DOUBLE) AS enter_short,
        lock = 0 AND pos > 0 AND close <= hi * (1 - {unwind}::DOUBLE) AS leave_long, lock = 0 AND pos < 0 AND close >= lo * (1 + {unwind}::DOUBLE) AS leave_short
      FROM (SELECT p.entity, p.i, p.close, s.pos, s.lock, CASE WHEN s.pos > 0 OR (s.pos = 0 AND s.lock = 0) THEN greatest(s.high, p.close) ELSE s.high END AS hi, CASE WHEN s.pos < 0 OR (s.pos = 0 AND s.lock = 0) THEN least(s.low, p.close) ELSE s.low END AS lo
        FROM {name} s JOIN px p ON p.entity = s.entity AND p.i = s.i + 1))))"""


def _sequence_sql() -> str:
    r = _sequence()
    avg = lambda n: roll("avg", "close", 1 - n, 0)
    lo, hi = roll("min", "close", -20, -1), roll("max", "close", -20, -1)
    head = sql("su", "", f"""
px AS MATERIALIZED (SELECT entity, date, close, row_number() OVER (PARTITION BY entity ORDER BY date) AS i, coalesce(CASE WHEN ({avg(5)}) < ({avg(20)}) THEN -1 WHEN ({avg(5)}) > ({avg(20)}) THEN 1 END, 0) AS crossing,
  coalesce(CASE WHEN close < ({lo}) THEN -1 WHEN close > ({hi}) THEN 1 END, 0) AS breakout FROM su),
sides AS MATERIALIZED (SELECT entity, date, close, i, coalesce(last_value(nullif(breakout, 0) IGNORE NULLS) OVER (PARTITION BY entity ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS side FROM px)""").rstrip()
    c, stop = r["hold"].get("c"), r["stop"].get("stop")
    held = f"""
held(entity, i, pos, lock) AS (
  SELECT entity, 0::BIGINT, 0, 0 FROM px WHERE i = 1
  UNION ALL
  SELECT p.entity, p.i, CASE WHEN s.lock = 0 AND p.crossing <> 0 THEN p.crossing ELSE s.pos END, CASE WHEN s.lock = 0 AND p.crossing <> 0 THEN {c - 1} ELSE greatest(s.lock - 1, 0) END FROM held s JOIN px p ON p.entity = s.entity AND p.i = s.i + 1)"""
    stopped = f"""
stopped(entity, i, pos, entry) AS (
  SELECT entity, 0::BIGINT, 0, NULL::DOUBLE FROM px WHERE i = 1
  UNION ALL
  SELECT entity, i, CASE WHEN (cur > 0 AND close <= entry * (1 - {stop}::DOUBLE)) OR (cur < 0 AND close >= entry * (1 + {stop}::DOUBLE)) THEN 0 ELSE cur END, entry
  FROM (SELECT p.entity, p.i, p.close, CASE WHEN p.side <> s.pos AND p.side <> 0 THEN p.side ELSE s.pos END AS cur, CASE WHEN p.side <> s.pos AND p.side <> 0 THEN p.close ELSE s.entry END AS entry FROM stopped s JOIN sides p ON p.entity = s.entity AND p.i = s.i + 1))"""
    filters = {k: _filter_sql(f"f_{k}", r[k]) for k in ("flip", "neutral", "locked")}
    names = {"hold": "held", "stop": "stopped", **{k: f"f_{k}" for k in filters}}
    body = " UNION ALL ".join(f"SELECT x.entity, px.date, CAST({r[k].rule_id} AS INTEGER) AS rule_id, CAST(x.pos AS TINYINT) AS pos FROM {n} x JOIN px ON px.entity = x.entity AND px.i = x.i" for k, n in names.items())
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + "," + ",".join([held, stopped, *filters.values()]) + "\n" + body


@query(_sequence_sql())
def rule_positions_locked(spark, sf):
    """A holding lock, three filters and a stop, each session following from the one before."""
    return rules.positions(su_daily(spark, sf), list(_sequence().values()))
