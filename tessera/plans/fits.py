"""Logits of one regressor beside SQL that iterates the same reweighted normal equations, and their use: per date,
Fama-MacBeth, pooled, and out of sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import compounded
from ..operators import portfolio, regress, signals, xsection
from ..sources.panels import su_daily
from .series import rounded
from .sqlkit import comp, sql

Q: dict = {}
S: dict = {}
STEPS = 40
SPLIT = "1996-01-01"


def query(sql_text: str):
    def add(f):
        Q[f.__name__] = f
        S[f.__name__] = sql_text
        return f

    return add


def _months(spark, sf):
    """Sign of the next five sessions' return and the last week's reversal at an entity's last session of a month."""
    su = su_daily(spark, sf).withColumns({"ahead": compounded("ret", 1, 5), "x": signals.reversal(signals.WEEK)})
    last = su.groupBy("entity", F.to_date(F.date_trunc("month", "date")).alias("month")).agg(F.max_by(F.struct("ahead", "x"), "date").alias("v"))
    return last.select("entity", F.col("month").alias("date"), xsection.binary_target(F.col("v.ahead")).alias("y"), "v.x")


_ROWS = f"""
r0 AS (SELECT entity, date, {comp(1, 5)} AS ahead, -({comp(-4, 0)}) AS x FROM su),
r1 AS (SELECT entity, CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS date FROM su GROUP BY ALL),
every AS (SELECT r0.entity, month AS date, CASE WHEN ahead > 0 THEN 1.0 ELSE 0.0 END AS y, x, ahead FROM r1 JOIN r0 USING (entity, date)),
whole AS MATERIALIZED (SELECT entity, date, y, x FROM every WHERE ahead IS NOT NULL AND x IS NOT NULL)"""


def _steps(rows: str, key: str) -> str:
    """Coefficients (a, b) by key after STEPS iterations from zero, for the rows of a common table expression."""
    out = [f"b0 AS (SELECT DISTINCT {key}, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {rows})"]
    for i in range(STEPS):
        out.append(f"""b{i + 1} AS MATERIALIZED (SELECT {key}, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS a, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS b FROM (
  SELECT {key}, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * z) AS t0, sum(w * x * z) AS t1 FROM (
    SELECT {key}, x, w, eta + (y - p) / w AS z FROM (SELECT *, 1 / (1 + exp(-eta)) AS p, greatest(1 / (1 + exp(-eta)) * (1 - 1 / (1 + exp(-eta))), 1e-8::DOUBLE) AS w FROM (SELECT {key}, x, y, greatest(least(a + b * x, 30.0::DOUBLE), -30.0::DOUBLE) AS eta FROM {rows} JOIN b{i} USING ({key})))) GROUP BY {key}))""")
    return ",\n".join(out)


_BY_DATE = _ROWS + ",\nd AS MATERIALIZED (SELECT * FROM whole WHERE date IN (SELECT date FROM whole GROUP BY date HAVING count(*) >= 30 AND count(DISTINCT y) = 2)),\n" + _steps("d", "date")
_TERMS = f"(SELECT date, 'const' AS term, a AS beta FROM b{STEPS} UNION ALL SELECT date, 'x', b FROM b{STEPS})"


@query(sql("su", f"SELECT date, term, round(beta, 6) AS beta FROM {_TERMS}", _BY_DATE))
def logit_by_month(spark, sf):
    """A logit per month."""
    return rounded(regress.logit_by_date(_months(spark, sf), "y", ["x"]), "beta")


@query(sql("su", "SELECT terms.term, max(n) AS n, max(lag) AS lag, round(avg(x), 6) AS mean, round(avg(x) / sqrt(max(s) / max(n) / max(n)), 4) AS t FROM terms JOIN y2 USING (term) GROUP BY terms.term", _BY_DATE + f""",
terms AS (SELECT date, term, beta AS x, beta - avg(beta) OVER (PARTITION BY term) AS e, count(*) OVER (PARTITION BY term) AS n, row_number() OVER (PARTITION BY term ORDER BY date) AS i FROM {_TERMS}),
y1 AS (SELECT *, CAST(least(greatest(floor(4 * pow(n / 100.0, 2.0 / 9.0)), 1), n - 1) AS INTEGER) AS lag FROM terms),
y2 AS (SELECT a.term, max(a.lag) AS lag, sum(CASE WHEN b.i = a.i THEN 1.0 ELSE 2 * (1 - (b.i - a.i) / (a.lag + 1.0)) END * a.e * b.e) AS s FROM y1 a JOIN y1 b ON a.term = b.term AND b.i BETWEEN a.i AND a.i + a.lag GROUP BY a.term)"""))
def fama_macbeth_month(spark, sf):
    """Means of the months' coefficients with Newey-West t."""
    d = regress.fama_macbeth(_months(spark, sf), "y", ["x"])
    return d.select("term", "n", "lag", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"))


def _likelihood(p: str) -> str:
    return f"sum(CASE WHEN y = 1 THEN ln(least(greatest({p}, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) ELSE ln(1 - least(greatest({p}, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) END)"


_POOLED = "\nd AS MATERIALIZED (SELECT *, 1 AS one FROM {rows}),\n" + _steps("d", "one")


@query(sql("su", f"SELECT n, round(ll, 6) AS ll, round(ll0, 6) AS ll0, round(100 * (1 - ll / ll0), 6) AS r2 FROM (SELECT count(*) AS n, {_likelihood('p')} AS ll, {_likelihood('p0')} AS ll0 FROM (SELECT y, 1 / (1 + exp(-(a + b * x))) AS p, avg(y) OVER () AS p0 FROM d JOIN b{STEPS} USING (one)))", _ROWS + "," + _POOLED.format(rows="whole")))
def pooled_logit_months(spark, sf):
    """One logit over all months and its McFadden R2."""
    return rounded(regress.pooled_fit(_months(spark, sf), "y", ["x"]), "ll", "ll0", "r2")


@query(sql("su", f"SELECT n, round(ll, 6) AS ll, CASE WHEN unseen = 0 THEN round(ll0, 6) END AS ll0, unseen, CASE WHEN unseen = 0 THEN round(100 * (1 - ll / ll0), 6) END AS r2 FROM (SELECT count(*) AS n, {_likelihood('p')} AS ll, {_likelihood('p_bench')} AS ll0, count(*) FILTER (p_bench IS NULL) AS unseen FROM (SELECT y, 1 / (1 + exp(-(a + b * x))) AS p, p_bench FROM d JOIN b{STEPS} USING (one) LEFT JOIN bench USING (entity)))",
           _ROWS + f""",
test AS (SELECT * FROM whole WHERE date >= DATE '{SPLIT}'),
train AS (SELECT entity, y FROM every WHERE date < DATE '{SPLIT}'),
bench AS (SELECT entity, CASE WHEN count(*) >= 12 THEN avg(y) ELSE (SELECT avg(y) FROM train) END AS p_bench FROM train GROUP BY entity),""" + _POOLED.format(rows="test")))
def out_of_sample_months(spark, sf):
    """The same on the test months, against each name's frequency in training, where a missing return counts as not positive."""
    d = _months(spark, sf)
    bench = portfolio.positive_rate(d.where(F.col("date") < SPLIT).withColumn("y", F.coalesce("y", F.lit(0))), "y")
    return rounded(regress.out_of_sample_fit(d.where(F.col("date") >= SPLIT), bench, "y", ["x"]), "ll", "ll0", "r2")
