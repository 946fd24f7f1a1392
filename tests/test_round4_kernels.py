"""Kernels that take many charts or rules at once beside those that take one."""

import numpy as np

from tessera.operators import raster


def _sessions(seed: int) -> dict[str, np.ndarray]:
    """Sessions of one entity with gaps, closes of zero, returns of -100 % and constant prices, as the seed has it."""
    rng = np.random.default_rng(seed)
    n, vola = int(rng.integers(1, 200)), (0.005, 0.05, 0.6, 0.0)[seed % 4]
    close = 100 * np.exp(np.cumsum(rng.normal(0, vola, n)))
    high, low = close * np.exp(abs(rng.normal(0, vola, n))), close * np.exp(-abs(rng.normal(0, vola, n)))
    out = {"open": low + (high - low) * rng.random(n), "high": high, "low": low, "close": close, "ret": np.r_[np.nan, close[1:] / close[:-1] - 1], "vol": rng.integers(0, 50, n).astype(float)}
    if seed % 3:
        out = {c: np.where(rng.random(n) < 0.08, np.nan, v) for c, v in out.items()}
        out["ret"][rng.random(n) < 0.02], out["close"][rng.random(n) < 0.02] = -1.0, 0.0
    return out


def _one_by_one(s: dict[str, np.ndarray], at: np.ndarray, window: int) -> dict[int, bytes]:
    out = {}
    o, h, low, c = (abs(s[x]) for x in ("open", "high", "low", "close"))
    for i in at[at >= window - 1]:
        first = i - window + 1
        w = slice(first - window if first >= window else first, i + 1)
        k = first - w.start
        adj = raster.chained(c[w], s["ret"][w])
        if not np.isfinite(adj[k]) or adj[k] == 0:
            continue
        scale, adj = adj / c[w] / adj[k], adj / adj[k]
        ma = np.lib.stride_tricks.sliding_window_view(adj, window).mean(axis=1)[-window:] if k else None
        img = raster.render(*(x[w][k:] * scale[k:] for x in (o, h, low)), adj[k:], s["vol"][w][k:], ma, window)
        if img is not None:
            out[int(i)] = raster.pack(img)
    return out


def test_charts_at_once_are_those_drawn_one_by_one():
    drawn = 0
    for seed in range(24):
        s = _sessions(seed)
        at = np.arange(len(s["close"]))[seed % 2 :: 2]
        for window in (5, 20, 60):
            with np.errstate(all="ignore"):
                want = _one_by_one(s, at, window)
                rows, bits = raster.drawn(s, at, window)
            assert dict(zip(rows.tolist(), (b.tobytes() for b in bits))) == want
            assert sum(int(np.bitwise_count(b).sum()) for b in bits) == sum(int(raster.unpack(i, window).sum()) for i in want.values())
            drawn += len(want)
    assert drawn > 500


def test_labelled_charts_in_one_pass_are_those_of_each_pair(spark):
    from pyspark.sql import functions as F

    from tessera.operators import signals, universe
    from tessera.plans import pipelines

    rng = np.random.default_rng(1)
    rows = [(e, k * step, float(100 + rng.normal(0, 5)), float(rng.integers(0, 9))) for e, step, n in ((1, 1, 150), (2, 2, 100), (3, 1, 30), (4, 5, 3)) for k in range(n)]
    d = spark.createDataFrame(rows, "entity long, k int, close double, vol double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k")))
    d = d.withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1, "ret": F.col("close") / 100 - 1}).drop("k")
    pairs = [(w, h) for w in (5, 20) for h in (5, 20, 60)]
    got = {tuple(r) for r in pipelines.labelled_charts(d, pairs).select("window", "horizon", "entity", "date", "image", "ret", "label", "year").collect()}
    want = set()
    for w, h in pairs:
        at = pipelines.as_of_rows(universe.without_final_rows(universe.with_history(d, w)), h)
        y = signals.forward_returns(d, (h,)).select("entity", "date", F.col(f"ret_{h}d").alias("r"))
        one = raster.charts(d, at.select("entity", "date"), w).join(y, ["entity", "date"])
        want |= {tuple(r) for r in one.select(F.lit(w), F.lit(h), "entity", "date", "image", "r", signals.label("r"), F.year("date")).collect()}
    assert got == want and len({(r[0], r[1]) for r in got}) == len(pairs)


def test_rules_that_share_signals_are_those_made_alone():
    from tessera.operators import rules

    every = rules.manifest()
    kernel = rules.Kernel(every)
    for seed in range(6):
        s = _sessions(seed)
        with np.errstate(all="ignore"):
            got = kernel.positions(s["close"], s["vol"])
            some = range(seed, len(every), 97)
            alone = np.column_stack([rules.evaluate(s["close"], s["vol"], [every[i]])[:, 0] for i in some])
        assert (got[:, list(some)] == alone).all()
    assert kernel.raws < len(every) - len(kernel.path)


def test_holding_locks_one_row_after_the_other():
    from tessera.operators import rules

    rng = np.random.default_rng(2)
    raw, c = rng.integers(-1, 2, (80, 60)).astype(np.int8), rng.choice([0, 1, 2, 5, 50, 300], 60)
    want = np.zeros_like(raw)
    for k in range(60):
        pos = lock = 0
        for i in range(80):
            if lock == 0 and raw[i, k]:
                pos, lock = raw[i, k], max(c[k] - 1, 0)
            else:
                lock = max(lock - 1, 0)
            want[i, k] = pos
    assert (rules.held(raw, c) == want).all()
    assert (rules.held(raw, np.minimum(c, 1)) == rules.held(raw, np.zeros(60, np.int64))).all()


def test_legs_by_counts_are_those_by_sorting():
    from tessera.operators import portfolio

    rng = np.random.default_rng(3)
    cells = np.stack([rng.choice(4, 37, p=p) for p in rng.dirichlet([0.4, 0.4, 0.4, 0.1], 50)], axis=1).astype(np.uint8)
    ret, weights = rng.normal(0, 0.1, 37), np.vstack([np.ones(37), rng.random(37)])
    with np.errstate(all="ignore"):
        got = portfolio.cells_high_low(cells, ret, weights, 5)
    counts = np.stack([(cells == k).sum(axis=0) for k in range(3)])
    low, high = portfolio._legs(np.ascontiguousarray(cells.T), counts.astype(float), 5)
    for r in range(50):
        there = np.flatnonzero(cells[:, r] < 3)
        order = there[np.argsort(cells[there, r], kind="stable")]
        grp = np.minimum(5, np.arange(len(order)) * 5 // max(len(order), 1) + 1)
        if len(order) < 5 or len(set(cells[there, r])) < 2:
            assert np.isnan(got[:, r]).all()
            continue
        assert set(np.flatnonzero(low[r])) == set(order[grp == 1]) and set(np.flatnonzero(high[r])) == set(order[grp == 5])
        leg = lambda own: (weights[:, own] * ret[own]).sum(axis=1) / weights[:, own].sum(axis=1)
        assert np.allclose(got[:, r], leg(order[grp == 5]) - leg(order[grp == 1]), rtol=1e-12)


def test_the_table_functions_rule_is_made_ready_once():
    from tessera.operators import rule_function

    assert rule_function._kernel(17) is rule_function._kernel(17)


def test_pooled_fits_from_rows_that_the_caller_holds(spark):
    from pyspark.sql import functions as F

    from tessera.operators import regress

    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(int(k % 7), float(rng.integers(0, 2)), float(rng.normal()), float(rng.normal())) for k in range(300)], "entity long, y double, a double, b double")
    models = {"one": ("y", ["a"]), "two": ("y", ["a", "b"])}
    bench = spark.createDataFrame([(e, 0.3 + e / 20) for e in range(6)], "entity long, p_bench double")
    want = regress.pooled_fits(regress.with_benchmark(regress.stacked(d, models, ("entity",)), bench))
    both = d.join(bench, "entity", "left")
    asked = []

    def rows(names):
        asked.append(names)
        return regress.stacked(both, {m: models[m] for m in names or models}, ("entity",), None, dict.fromkeys(models, "p_bench"))

    got = regress.pooled_fits(rows)
    assert asked[0] is None and len(asked) > 2
    for m in models:
        assert np.allclose(got[m].beta, want[m].beta, atol=1e-9) and got[m].unseen == want[m].unseen > 0 and np.isclose(got[m].ll_bench, want[m].ll_bench)


def test_models_rows_meet_by_date_without_a_shuffle(spark):
    from pyspark.sql import functions as F

    from tessera.operators import regress
    from tessera.plans import tables

    d = spark.range(400).select(F.expr("date_add(date'2020-01-01', cast(id % 3 as int))").alias("date"), (F.col("id") % 2).cast("double").alias("y"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    models = {"one": ("y", ["a"]), "two": ("y", ["a", "b"])}
    held = tables._by_date(d)
    held.count()
    out = regress.logits_by_date(regress.stacked(held, models, ("date",)), {m: xs for m, (_, xs) in models.items()})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("InMemoryTableScan")] and out.count() == 3 * 2 + 3 * 3
    held.unpersist()


def test_the_market_meets_a_panel_without_a_shuffle(spark):
    from pyspark.sql import functions as F

    from tessera.operators import signals

    d = spark.range(50).select(F.lit(1).cast("long").alias("entity"), F.expr("date_add(date'2020-01-01', cast(id as int))").alias("date"), F.rand(1).alias("ret"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = signals.rolling_beta(d, d.groupBy("date").agg(F.avg("ret").alias("mkt_ret")), 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rank_correlations_shuffle_a_row_a_name_and_not_each_pair(spark):
    from pyspark.sql import functions as F

    from tessera.plans import tables

    d = spark.range(90).select(F.expr("date_add(date'2020-01-01', cast(id % 2 as int))").alias("date"), *(F.rand(i).alias(c) for i, c in enumerate([f"p{w}" for w, _ in tables.CHARTS] + ["mom", "beta"])))
    plan = tables.rank_correlations(d, ("mom", "beta"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [date" in plan


def test_ranges_of_ranks_have_one_set_of_cuts(spark):
    from pyspark.sql import functions as F

    from tessera.operators import xsection

    d = spark.range(60).select(F.lit(1).alias("date"), F.rand(1).alias("v"))
    plan = xsection.ranked_in_ranges(d, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation [date") == 2


def test_charts_at_a_condition_are_not_joined(spark):
    from tessera.plans import models

    d = models._charts(spark, "/root/testdata/sf0.001")
    assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_pixels_counted_where_charts_are_drawn(spark):
    from tessera.plans import models

    counted, plain = (models._charts(spark, "/root/testdata/sf0.001", counted=c) for c in (True, False))
    assert raster.pixel_stats(counted, 5).first() == raster.pixel_stats(plain, 5).first()
