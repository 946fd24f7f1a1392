"""Factors, many fits in one iteration, tables' cells, interval joins, mergeable counts and the table function."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import asof, counts, least_squares, regress, rule_function, rules
from tessera.plans import tables


def test_factors_solve_collinear_columns():
    rng = np.random.default_rng(3)
    base = rng.normal(size=5000)
    x = np.column_stack([np.ones(5000), *(base + 1e-5 * rng.normal(size=5000) for _ in range(8))])
    y = x @ rng.normal(size=9) + rng.normal(size=5000)
    rows = np.column_stack([x, y])
    parts = [least_squares.factor(p).ravel().tolist() for p in np.array_split(rows, 13)]
    got = least_squares.solve(least_squares.merged(parts, 10), 5000)
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.abs(got - want).max() <= 1e-8 * np.abs(want).max()
    # normal equations do not reach that
    assert np.abs(np.linalg.lstsq(x.T @ x, x.T @ y, rcond=None)[0] - want).max() > 1e-6
    twice = np.column_stack([x, x[:, 3], y])
    got = least_squares.solve(least_squares.factor(twice), 5000)
    assert np.allclose(got, np.linalg.lstsq(twice[:, :-1], y, rcond=None)[0], atol=1e-6 * np.abs(want).max())


def test_trend_scores_follow_lstsq(spark):
    rng = np.random.default_rng(5)
    ma, days = ["a", "b", "c"], [dt.date(2020, m, 1) for m in range(1, 7)]
    rows = [(e, d, *map(float, rng.normal(size=1).repeat(3) + 1e-4 * rng.normal(size=3)), float(rng.normal())) for d in days for e in range(10 if d == days[2] else 60)]
    rows[5] = (*rows[5][:3], None, *rows[5][4:])
    df = spark.createDataFrame(rows, "entity long, date date, a double, b double, c double, ret double")
    got = {(r.entity, r.date): r.trend_score for r in regress.trend_scores(df, ma, "ret").collect()}
    beta = None
    for before, d in zip([None, *days], days):
        prev = [r for r in rows if r[1] == before and None not in r]
        score = None
        if len(prev) >= 30:
            x = np.array([[1, *r[2:5]] for r in prev])
            new = np.linalg.lstsq(x, np.array([r[5] for r in prev]), rcond=None)[0]
            beta = new if beta is None else 0.9 * beta + 0.1 * new
            score = beta
        for r in (r for r in rows if r[1] == d):
            want = None if score is None or None in r[2:5] else float(score @ np.array([1, *r[2:5]]))
            assert got[r[0], d] == (want if want is None else pytest.approx(want, rel=1e-8, abs=1e-8))


def _single(x, y, steps=60):
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    return beta, float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def test_many_fits_side_by_side(spark, monkeypatch):
    passes = []
    plain = regress._pass
    monkeypatch.setattr(regress, "_pass", lambda rows, fits: passes.append(sorted(fits)) or plain(rows, fits))
    rng = np.random.default_rng(9)
    rows = []
    for e in range(400):
        a, b = rng.normal(size=2)
        rows.append((e, float(a), float(b) if e % 7 else None, float(rng.random() < 1 / (1 + math.exp(-a))), float(rng.random() < 1 / (1 + math.exp(-3 * a - 1))), 0.3 if e % 5 else None))
    d = spark.createDataFrame(rows, "entity long, a double, b double, y double, z double, p double").repartition(5)
    models = {"one": ("y", ["a"]), "two": ("y", ["a", "b"]), "steep": ("z", ["a", "b"]), "none": ("y", ["a"])}
    bench = spark.createDataFrame([(r[0], r[5]) for r in rows if r[5]], "entity long, p_bench double")
    stack = regress.stacked(d, models, ("entity",), {"none": F.lit(False)})
    fits = regress.pooled_fits(regress.with_benchmark(stack, bench))
    assert set(fits) == {"one", "two", "steep"}
    for m, f in fits.items():
        y, xs = models[m]
        at = {"a": 1, "b": 2, "y": 3, "z": 4}
        own = [r for r in rows if all(r[at[c]] is not None for c in xs)]
        beta, ll = _single(np.array([[r[at[c]] for c in xs] for r in own]), np.array([r[at[y]] for r in own]))
        n1 = sum(r[at[y]] for r in own)
        ll0 = n1 * math.log(n1 / len(own)) + (len(own) - n1) * math.log(1 - n1 / len(own))
        assert f.n == len(own) and np.allclose(f.beta, beta, atol=1e-7) and f.ll == pytest.approx(ll) and f.r2(f.ll0) == pytest.approx(100 * (1 - ll / ll0))
        seen = [r for r in own if r[5]]
        assert f.unseen == len(own) - len(seen) and f.ll_bench == pytest.approx(sum(math.log(0.3 if r[at[y]] else 0.7) for r in seen))
    # one pass serves all models, and those that have converged drop out
    assert passes[0] == ["one", "steep", "two"] and len(passes[-1]) < 3 and len(passes) < 14


def test_a_step_is_halved_where_the_likelihood_falls(spark):
    # a start from zero overshoots on far-off points with rare ones
    x = np.r_[np.linspace(-1, 1, 200), 60.0]
    y = np.r_[(np.linspace(-1, 1, 200) > 0.3).astype(float), 0.0]
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, y double")
    beta = regress.pooled_logit(d, "y", ["a"])
    ll = lambda c: sum(b * t - math.log1p(math.exp(t)) if t < 30 else b * t - t for a, b in zip(x, y) for t in [c[0] + c[1] * a])
    assert all(ll(beta) >= ll([beta[0] + i, beta[1] + j]) - 1e-9 for i in (-1e-3, 0, 1e-3) for j in (-1e-3, 0, 1e-3))


def test_cells_without_figures_stay(spark):
    rng = np.random.default_rng(2)
    rows = [(e, dt.date(1995, m, 1), 1.0, float(rng.normal()), *map(float, rng.random(3))) for m in (1, 2, 3) for e in range(40)]
    d = spark.createDataFrame(rows, "entity long, date date, flat double, b double, p5 double, p20 double, p60 double")
    got = {(r.model, r.characteristic): (r.n, r.mean) for r in tables.rank_correlations(d, ("flat", "b")).collect()}
    assert len(got) == 6 and all(got[m, "flat"] == (0, None) and got[m, "b"][0] == 3 for m in ("I5/R5", "I20/R5", "I60/R5"))
    thin = {(r.model, r.term): (r.n, r.mean) for r in tables.prediction_logit(d.where("entity < 9"), ("b",)).collect()}
    assert len(thin) == 9 and all(v == (0, None) or k[1] == "mcfadden_r2" for k, v in thin.items())


def test_interval_join(spark):
    rng = random.Random(1)
    day = dt.date(2020, 1, 1)
    points = [(rng.randrange(3), day + dt.timedelta(rng.randrange(400)), i) for i in range(300)]
    spans = []
    for j in range(25):
        a, b = sorted((rng.randrange(-50, 450), rng.randrange(-50, 450)))
        spans.append((rng.randrange(3), day + dt.timedelta(a) if j % 6 else None, day + dt.timedelta(b) if j % 4 else None, j))
    spans.append((1, day + dt.timedelta(9), day + dt.timedelta(8), 99))
    p = spark.createDataFrame(points, "entity long, date date, i int")
    s = spark.createDataFrame(spans, "entity long, since date, until date, j int")
    got = sorted((r.i, r.j) for r in asof.range_join(p, s, ("entity",), days=10).collect())
    want = sorted((i, j) for e, d, i in points for f, a, b, j in spans if e == f and (a is None or a <= d) and (b is None or d <= b))
    assert got == want and len(got) > 300
    joined = asof.range_join(p, s.drop("entity"), days=30)
    assert joined.count() == sum((a is None or a <= d) and (b is None or d <= b) for _, d, _ in points for _, a, b, _ in spans)
    plan = asof.range_join(p.hint("merge"), s, ("entity",))._jdf.queryExecution().executedPlan().toString()
    assert "Join [entity" in plan


def test_sketches_merge(spark):
    d = spark.range(20_000).selectExpr("id % 7 AS shard", "id % 5000 AS x", "CAST(id % 3 AS string) AS y")
    stored = counts.sketches(d, ["shard"], ("x", "y"))
    r = counts.merged(stored.withColumn("all", F.lit(1)), ["all"], ("x", "y")).first()
    assert r.n == 20_000 and abs(r.n_x - 5000) <= 4 * counts.relative_error() * 5000 and r.n_y == 3


def test_rule_table_function(spark):
    rng = random.Random(6)
    rows = [(e, dt.date(2020, 1, 1) + dt.timedelta(i), 50 + rng.random() * 20 if i != 7 else None, 1.0) for e in (1, 2) for i in range(60)]
    d = spark.createDataFrame(rows, "entity long, date date, close double, vol double")
    d.createOrReplaceTempView("some_panel")
    rule_function.register(spark)
    chosen = [r for r in rules.manifest() if r.variant in ("hold", "range_stop")][::60]
    for r in chosen:
        got = spark.sql(f"SELECT * FROM rule_positions(TABLE(some_panel) PARTITION BY entity ORDER BY (date), {r.rule_id})")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rules.positions(d, [r]).collect()))
    with pytest.raises(Exception, match="no rule"):
        spark.sql("SELECT * FROM rule_positions(TABLE(some_panel) PARTITION BY entity ORDER BY (date), 99999)").count()
