"""Operators against plain Python on hand-made panels."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from tessera.operators import asof, calendar, portfolio, raster, regress, rules, signals, stats, universe, xsection
from tessera.sources import io

DAY = dt.date(2020, 1, 1)


def days(n):
    return [DAY + dt.timedelta(d) for d in range(n)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ewma_matches_pandas_with_gaps_and_long_history(spark):
    rng = np.random.default_rng(0)
    n = 4500
    r = rng.normal(0, 0.02, n)
    r[[3, 100, 101, 2000, 2500]] = np.nan
    df = frame(spark, [(1, d, None if np.isnan(x) else float(x)) for d, x in zip(days(n), r)], "entity long, date date, ret double")
    got = signals.ewma_vol(df).orderBy("date").toPandas()["ewma_vol"].to_numpy(float)
    want = pd.Series(r).ewm(span=60, min_periods=60).std(bias=False).to_numpy()
    assert (np.isnan(got) == np.isnan(want)).all() and np.nanmax(np.abs(got - want)) < 1e-9


def test_forward_return_needs_its_whole_window_and_guards_total_loss(spark):
    r = [0.1, 0.2, -1.0, 0.1, None, 0.3, 0.1, 0.1]
    df = frame(spark, list(zip([1] * 8, days(8), r)), "entity long, date date, ret double")
    got = [x.ret_2d for x in signals.forward_returns(df, (2,)).orderBy("date").collect()]
    assert [g is None for g in got] == [True, True, True, True, False, False, True, True]
    assert got[4:6] == pytest.approx([1.3 * 1.1 - 1, 1.1 * 1.1 - 1])


def test_groups_are_not_ntile_and_ties_go_by_entity(spark):
    rows = [(e, DAY, float(e // 3)) for e in range(13)]
    got = {r.entity: r.grp for r in xsection.quantile_groups(frame(spark, rows, "entity long, date date, signal double"), 10).collect()}
    assert got == {e: min(10, e * 10 // 13 + 1) for e in range(13)}


def test_constant_cross_section_is_missing(spark):
    rows = [(e, DAY, 0.1) for e in range(5)]
    assert all(r.signal is None for r in xsection.standardised(frame(spark, rows, "entity long, date date, signal double")).collect())


def test_turnover_counts_moves_between_groups_and_the_last_date(spark):
    d = days(2)
    rows = [(1, d[0], 1, 1.0), (2, d[0], 1, 1.0), (3, d[0], 2, 1.0), (1, d[1], 1, 1.0), (2, d[1], 2, 1.0), (4, d[1], 2, 3.0)]
    w = frame(spark, [("equal", *r) for r in rows], "scheme string, entity long, date date, grp int, w double")
    got = {(r.date, r.grp): r.turnover for r in portfolio.turnover_by_date(w).collect()}
    assert got == {(d[0], 1): 1.0, (d[0], 2): 2.0, (d[1], 1): 1.0, (d[1], 2): 1.0}
    assert {r.date for r in portfolio.turnover_by_date(w, drop_last=True).collect()} == {d[0]}


def test_lagged_return_follows_dates_not_rows(spark):
    d = days(3)
    s = frame(spark, [(1, d[0], 0.1), (1, d[1], 0.2), (1, d[2], 0.3), (2, d[0], 0.4), (2, d[2], 0.5)], "entity long, date date, ret double")
    got = {(r.entity, r.date): r.ret for r in asof.lagged_return(s, s, 1).collect()}
    assert got == {(1, d[0]): 0.2, (1, d[1]): 0.3}


def test_as_of_join_looks_back_without_limit(spark):
    d = days(6)
    left = frame(spark, [(1, d[0]), (1, d[2]), (1, d[5]), (2, d[5])], "entity long, date date")
    right = frame(spark, [(1, d[1], 0.1), (1, d[4], 0.4)], "entity long, date date, p double")
    got = {(r.entity, r.date): r.p for r in asof.as_of_join(left, right, "p").collect()}
    assert got == {(1, d[0]): None, (1, d[2]): 0.1, (1, d[5]): 0.4, (2, d[5]): None}


def test_newey_west(spark):
    x = np.random.default_rng(1).normal(0.1, 1, 150)
    df = frame(spark, [("a", d, float(v)) for d, v in zip(days(150), x)], "k string, date date, x double")
    r = stats.mean_t(df, "x", ["k"]).first()
    e, n = x - x.mean(), len(x)
    lag = min(max(1, math.floor(4 * (n / 100) ** (2 / 9))), n - 1)
    s = (e @ e) / n + sum(2 * (1 - k / (lag + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lag + 1))
    assert (r.n, r.lag) == (n, lag) and r.t == pytest.approx(x.mean() / math.sqrt(s / n))


def test_logit_by_date_and_skips(spark):
    rng = np.random.default_rng(2)
    d = days(3)
    rows = []
    for i, day in enumerate(d):
        for k in range(60 if i < 2 else 10):
            x = float(rng.normal())
            rows.append((k, day, x, float(rng.random() < 1 / (1 + math.exp(-x)))))
    got = regress.logit_by_date(frame(spark, rows, "entity long, date date, x double, y double"), "y", ["x"]).collect()
    assert {r.date for r in got} == set(d[:2]) and all(0 < r.beta < 3 for r in got if r.term == "x")


def test_rule_queries_take_all_rules(spark, monkeypatch):
    from tessera.plans import pipelines, registry

    taken = []
    monkeypatch.setattr(pipelines, "rule_scan", lambda panel, chosen, *a: taken.extend(chosen))
    registry.QUERIES["rule_scan"](spark, "/root/testdata/sf0.001")
    assert taken == rules.manifest()
    got = registry.QUERIES["rule_positions_sequential"](spark, "/root/testdata/sf0.001").groupBy("rule_id").count().collect()
    assert {r.rule_id for r in got} == {r.rule_id for r in rules.manifest() if not rules.native(r)}
    assert len({r["count"] for r in got}) == 1


def test_manifest():
    m = rules.manifest()
    assert [r.rule_id for r in m] == list(range(1, 7847)) and m[0].name == "STW_0001_FR_simple_x0p005" and len({r.name for r in m}) == 7846


NAN = float("nan")
#: Worked by hand: rule (x, unwind, lock), prices, positions.
FILTER_PATHS = [
    # flips: long 10 % above the low of 100, short 10 % below the high of 121, long 10 % above the low of 100
    ((0.1, NAN, 0), [100, 105, 111, 121, 108, 100, 111], [0, 0, 1, 1, -1, -1, 1]),
    # a fall from flat first; a missing price and one of zero change nothing
    ((0.1, NAN, 0), [100, 89, NAN, 0, 95, 98.5], [0, -1, -1, -1, -1, 1]),
    # unwinds at 5 % to flat, where both references start again
    ((0.1, 0.05, 0), [100, 111, 120, 113, 120, 107.9, 113.5, 125], [0, 1, 1, 0, 0, -1, 0, 1]),
    # locked for the two rows after an entry, while the own extreme is still followed
    ((0.1, NAN, 3), [100, 111, 90, 80, 79, 200, 200, 200], [0, 1, 1, 1, -1, -1, -1, 1]),
    # the extreme of locked rows counts: 130 sets the high that 116 is 10 % below
    ((0.1, NAN, 3), [100, 111, 130, 130, 116], [0, 1, 1, 1, -1]),
    ((0.1, NAN, 0), [NAN, NAN], [0, 0]),
]


def test_filter_rules_follow_paths_worked_by_hand():
    for (x, y, c), price, want in FILTER_PATHS:
        got = rules.filtered(np.array(price, float), np.array([x]), np.array([y]), np.array([c]))
        assert got.ravel().tolist() == want


def test_rules_side_by_side_do_not_mix():
    n = max(len(p) for _, p, _ in FILTER_PATHS)
    one = [100, 111, 120, 113, 120, 107.9, 113.5, 125]
    params = [f for f, _, _ in FILTER_PATHS]
    x, y, c = (np.array(v) for v in zip(*params))
    both = rules.filtered(np.array(one), x, y, c)
    for i in range(len(params)):
        assert both[:, i].tolist() == rules.filtered(np.array(one), x[i : i + 1], y[i : i + 1], c[i : i + 1]).ravel().tolist()
    assert n == 8


def test_holding_locks():
    raw = np.array([[1], [-1], [-1], [0], [-1], [1]], np.int8)
    hold = lambda c: rules.held(raw, np.array([c])).ravel().tolist()
    assert hold(0) == [1, -1, -1, -1, -1, 1]
    assert hold(1) == [1, -1, -1, -1, -1, 1]
    assert hold(3) == [1, 1, 1, 1, -1, -1]
    assert hold(10) == [1] * 6
    assert rules.held(np.repeat(raw, 2, axis=1), np.array([0, 3])).T.tolist() == [hold(0), hold(3)]


def test_stop_leaves_and_re_enters():
    pos = np.array([[1], [1], [1], [1]], np.int8)
    assert rules.stopped(pos, np.array([100.0, 97.0, 97.0, 90.0]), np.array([0.02])).ravel().tolist() == [1, 0, 1, 0]


def test_native_rules_match_kernel(spark):
    rng = np.random.default_rng(4)
    n = 320
    rows = [(e, d, float(p), float(v)) for e in (1, 2) for d, p, v in zip(days(n), np.exp(np.cumsum(rng.normal(0, 0.02, n))), rng.integers(1, 9, n))]
    df = frame(spark, rows, "entity long, date date, close double, vol double")
    chosen = [r for r in rules.manifest() if rules.native(r)][::211]
    key = lambda d: {(r.entity, r.date, r.rule_id): r.pos for r in d.collect()}
    assert key(rules.native_positions(df, chosen)) == key(rules.positions(df, chosen))


def test_charts_pack_and_unpack(spark):
    rng = np.random.default_rng(5)
    n = 12
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    rows = [(1, d, float(c * 0.99), float(c * 1.02), float(c * 0.98), float(c), 10.0 + i, None if i == 0 else float(c / close[i - 1] - 1)) for i, (d, c) in enumerate(zip(days(n), close))]
    df = frame(spark, rows, "entity long, date date, open double, high double, low double, close double, vol double, ret double")
    got = raster.charts(df, df.select("entity", "date"), 5).orderBy("date").collect()
    assert len(got) == n - 4 and all(len(r.image) == 60 for r in got)
    img = raster.unpack(got[-1].image, 5)
    assert img.shape == (32, 15) and raster.pack(img) == got[-1].image and img[0].any() and img[25].any()
    assert not img[26:, 0::3].any() and img[31, 1::3].all()
    s = raster.pixel_stats(raster.charts(df, df, 5), 5).first()
    p = sum(raster.unpack(r.image, 5).sum() for r in got) / (480 * len(got))
    assert s.mean == pytest.approx(255 * p) and s.std == pytest.approx(255 * math.sqrt(p * (1 - p)))


def test_chart_pixels_with_an_average_that_leaves_the_panel():
    """Prices 100 to 110 over 26 rows: a row is 0.4; the average runs from below the panel to above it, past a gap."""
    o = np.array([100.0, 104, 104, 104, 104])
    h, low, c = np.array([110.0, 104, 106, 104, 108]), np.array([100.0, 104, 104, 106, 102]), np.array([110.0, 104, 106, np.nan, 104])
    vol, ma = np.array([5.0, 10, 0, np.nan, 1]), np.array([98.0, 100, np.nan, 114, 104])
    img = raster.render(o, h, low, c, vol, ma, 5)
    want = np.zeros((32, 15), np.uint8)
    row = lambda v: round((110 - v) / 10 * 25)
    for d in range(5):
        a, b = sorted((row(h[d]), row(low[d])))
        want[a : b + 1, 3 * d + 1] = 1  # high below low is a bar too
        want[row(o[d]), 3 * d] = 1
        if c[d] == c[d]:
            want[row(c[d]), 3 * d + 2] = 1
    for d, tall in ((0, 2), (1, 5), (4, 1)):  # of 6 rows: halves to even of 5/10 * 5, 10/10 * 5; at least one
        want[32 - tall :, 3 * d + 1] = 1
    # the average: day 0 lies five rows below the panel, day 1 on its last row, day 2 is missing, day 3 ten rows above
    want[25, 3:6] = 1
    want[row(104), 12:15] = 1
    # from (25, 4) to (-10, 10), cut at row 0 where the column is 4 + 6 * 25 / 35 = 8.29, so 8: 25 rows over 4 columns;
    # the middle column 7 is 3 of 4 columns on, nearest for rows 25 - k with 2.5 < k * 4 / 25 <= 3.5
    want[[25 - k for k in range(26) if 2.5 < k * 4 / 25 <= 3.5], 7] = 1
    want[[25 - k for k in range(26) if k * 4 / 25 <= 0.5], 4] = 1
    # from (-10, 10) to (15, 13), cut at row 0 where the column is 10 + 3 * 10 / 25 = 11.2, so 11: 15 rows over 2 columns
    want[[k for k in range(16) if k * 2 / 15 > 1.5], 13] = 1
    # from (30, 1) to (25, 4), cut at row 25: the one pixel at its end
    assert (img == want).all()


def test_errors_that_would_hide_bad_input(spark):
    from pyspark.sql import functions as F

    df = frame(spark, [(i, DAY, float(i)) for i in range(4)], "entity long, date date, signal double")
    with pytest.raises(Exception, match="fewer than 5 names"):
        xsection.quantile_groups(df, 5).collect()
    assert xsection.quantile_groups(df, 5, thin="drop").count() == 0 and xsection.quantile_groups(df, 4).count() == 4
    first, later = portfolio.holding_split(F.col("signal") - 1, F.col("signal"))
    with pytest.raises(Exception, match="-100 %"):
        df.select(first, later).collect()
    assert df.select(portfolio.holding_split(F.col("signal") - 1, F.col("signal"), strict=False)[1].alias("x")).orderBy("x").first().x is None
    with pytest.raises(ValueError):
        universe.to_universe(df, df.where("entity > 9"), must=True)


def test_wide_has_every_group(spark):
    rows = [(s, g, m, float(g)) for s in ("equal", "total") for g in range(4) for m in portfolio.METRICS]
    got = portfolio.wide(frame(spark, rows, "scheme string, grp int, metric string, value double"), ["scheme"], 3).collect()
    names = {f"{m}_{g}" for m in portfolio.METRICS for g in ("DH", "D01", "D02", "D03")}
    assert set(got[0].asDict()) == names | {"scheme"} and all(r.sharpe_D02 == 2.0 and r.turnover_DH == 0.0 for r in got)


def test_backtests_side_by_side_equal_one_at_a_time(spark):
    rng = np.random.default_rng(7)
    rows = [(m, e, d, float(rng.normal()), float(rng.normal(0, 0.02)), float(rng.integers(1, 50))) for m in ("a", "b") for e in range(15) for d in days(12) if rng.random() < 0.8]
    df = frame(spark, rows, "model string, entity long, date date, signal double, ret double, cap double")
    key = lambda d: {(r.model, r.scheme, r.grp, r.metric): r.value for r in d.collect()}
    from pyspark.sql import functions as F

    both = key(portfolio.backtest(df, 3, 12, keys=("model",)))
    for m in ("a", "b"):
        one = key(portfolio.backtest(df.where(F.col("model") == m).drop("model"), 3, 12).withColumn("model", F.lit(m)))
        assert {k: v for k, v in both.items() if k[0] == m} == one and len(one) == 3 * (4 * 9 + 1)


def test_turnover_worked_by_hand(spark):
    d = days(3)
    # entity 1 stays (1, 0.5, 1), entity 2 comes at the second date and goes
    rows = [("equal", 1, 1, d[0], 2.0), ("equal", 1, 1, d[1], 3.0), ("equal", 2, 1, d[1], 3.0), ("equal", 1, 1, d[2], 1.0)]
    w = frame(spark, rows, "scheme string, entity long, grp int, date date, w double")
    assert {r.date: r.turnover for r in portfolio.turnover_by_date(w).collect()} == {d[0]: 1.0, d[1]: 1.0, d[2]: 1.0}
    assert {r.date: r.turnover for r in portfolio.turnover_by_date(w, drop_last=True).collect()} == {d[0]: 1.0, d[1]: 1.0}


def test_universe_predicates(spark):
    from pyspark.sql import functions as F

    df = frame(spark, [("600001", "A"), ("200012", "*ST x"), ("7", None), ("1234567", " ")], "code string, name string")
    got = df.select(universe.zero_padded(F.col("code")), universe.has_prefix(F.col("code")), universe.matches(F.col("name"))).collect()
    assert [tuple(r) for r in got] == [("600001", False, False), ("200012", True, True), ("000007", False, False), ("1234567", False, False)]


def test_sources_round_trip(spark, tmp_path):
    df = frame(spark, [(1, DAY, 1.0), (2, DAY, 2.0)], "entity long, date date, x double")
    io.write_panel(df, f"{tmp_path}/p.parquet")
    assert io.read_table(spark, f"{tmp_path}/p.parquet").count() == 2
    io.write_dual(df, f"{tmp_path}/d")
    assert io.read_table(spark, f"{tmp_path}/d.csv").count() == 2
    io.write_bucketed(df, "bucketed_panel", 2)
    assert spark.table("bucketed_panel").count() == 2
    io.write_json_lines(df, f"{tmp_path}/j.json")
    assert io.read_table(spark, f"{tmp_path}/j.json").count() == 2
    from pyarrow import feather

    feather.write_feather(df.toArrow(), f"{tmp_path}/f.feather")
    assert io.read_table(spark, f"{tmp_path}/f.feather").count() == 2
    with pytest.raises(ValueError):
        io.require_unique(df.unionByName(df), "entity")
    with pytest.raises(KeyError):
        io.read_row(df, 9, DAY)
    text = "PERMNO,HdrCUSIP,Ticker,PERMCO,DlyCalDt,DlyCap,DlyRet,DlyRetx,DlyVol,DlyClose,DlyLow,DlyHigh,DlyOpen\n7,a,b,1,2020-01-02,1,0.1,0.1,5,10,9,11,9.5\n"
    (tmp_path / "raw.csv").write_text(text)
    r = io.read_ohlc_csv(spark, f"{tmp_path}/raw.csv").first()
    assert (r.PERMNO, r.DlyCalDt, r.DlyOpen) == (7, dt.date(2020, 1, 2), 9.5)


def test_second_source_and_stored_results(spark, tmp_path):
    dsf = spark.createDataFrame([("000012", "2020-01-02", 1.0, 2.0, 0.5, 1.5, 9.0, 0.1, 30.0, 50.0)], "SecuCode string, date string, oprc double, high double, low double, prc double, svol double, ret double, float double, totcap double")
    r = io.map_dsf(dsf).first()
    assert (r.PERMNO, r.DlyCalDt, r.DlyOpen, r.DlyHigh, r.DlyLow, r.DlyClose, r.DlyVol, r.DlyRet, r.DlyCap, r.DlyFloatCap, r.DlyTotalCap) == (12, dt.date(2020, 1, 2), 1.0, 2.0, 0.5, 1.5, 9.0, 0.1, 30.0, 30.0, 50.0)
    with pytest.raises(KeyError):
        io.map_dsf(dsf.drop("totcap"))
    (tmp_path / "etf.csv").write_text("Date,Close,Volume\n2020-01-02,10.5,7\n")
    assert io.read_prices(spark, f"{tmp_path}/etf.csv").collect()[0].asDict() == {"date": dt.date(2020, 1, 2), "close": 10.5, "volume": 7.0}
    perf = frame(spark, [("equal", 0, "sharpe", 1.5), ("total", 0, "sharpe", None)], "scheme string, grp int, metric string, value double")
    io.write_performance(perf, f"{tmp_path}/perf")
    assert io.performance_cell(io.read_performance(spark, f"{tmp_path}/perf", "equal"), "equal", 0, "sharpe") == 1.5
    assert io.performance_cell(io.read_performance(spark, f"{tmp_path}/perf"), "total", 0, "sharpe") is None
    for bad in (lambda: io.read_performance(spark, f"{tmp_path}/perf", "float"), lambda: io.performance_cell(perf, "equal", 1, "sharpe")):
        with pytest.raises(KeyError):
            bad()


def test_resumed_runs_make_a_table_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = f"{tmp_path}/step"
    assert io.resumed(spark, path, make).count() == 3 and io.resumed(spark, path, make).count() == 3 and made == [1]
    (tmp_path / "step" / "_SUCCESS").unlink()
    assert io.resumed(spark, path, make).count() == 3 and made == [1, 1]


def test_arrow_files_of_several_batches(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import feather

    for i in range(2):
        feather.write_feather(pa.table({"x": list(range(1000 * i, 1000 * i + 1000)), "s": [f"é{j}" for j in range(1000)]}), f"{tmp_path}/{i}.feather", chunksize=300)
    got = io.read_table(spark, f"{tmp_path}/*.feather")
    assert got.dtypes == [("x", "bigint"), ("s", "string")] and got.agg({"x": "sum"}).first()[0] == sum(range(2000))


def test_calendar_windows_raise_or_leave_out(spark):
    cal = calendar.market_calendar(frame(spark, [(d,) for d in days(10)], "date date"))
    at = lambda *d: frame(spark, [(x,) for x in d], "date date")
    d = days(10)
    assert [r.date for r in calendar.window_dates(cal, at(d[4]), 3).orderBy("step").collect()] == d[2:5]
    assert [r.date for r in calendar.window_dates(cal, at(d[4]), 3, forward=True).orderBy("step").collect()] == d[5:8]
    for bad, forward in ((d[1], False), (d[8], True), (d[9] + dt.timedelta(days=30), False)):
        with pytest.raises(Exception, match="trading day"):
            calendar.window_dates(cal, at(bad), 3, forward).collect()
        assert calendar.window_dates(cal, at(bad), 3, forward, strict=False).count() == 0


def test_command_line(spark, tmp_path):
    from tessera import __main__ as cli
    from tessera.sources.panels import su_daily

    su_daily(spark, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/p.parquet")
    run = lambda verb, *more: cli.main([verb, "--panel", f"{tmp_path}/p.parquet", "--out", f"{tmp_path}/{verb}", *more], spark)
    perf = run("backtest", "--groups", "2", "--thin", "drop", "--eval-horizons", "1", "2", "--start", "1993-01-01", "--top-n", "8", "--signal", "close")
    assert {r.eval_horizon for r in perf.select("eval_horizon").distinct().collect()} == {1, 2}
    assert run("labels", "--entity-limit", "3").select("entity").distinct().count() == 3
    assert run("scan", "--rules", "40", "--groups", "2").count() > 0
    assert run("holding", "--groups", "2", "--thin", "drop").count() > 0
    wide = su_daily(spark, "/root/testdata/sf0.001").selectExpr("*", "cap * (1 + entity) AS all_cap")
    wide.write.parquet(f"{tmp_path}/w.parquet")
    both = lambda *more: cli.main(["backtest", "--panel", f"{tmp_path}/w.parquet", "--out", f"{tmp_path}/both", "--groups", "2", "--thin", "drop", "--signal", "close", "vol", *more], spark)
    plain = {(r.model, r.scheme, r.grp, r.metric): r.value for r in both().collect()}
    caps = {(r.model, r.scheme, r.grp, r.metric): r.value for r in both("--total-cap", "all_cap", "--periods-per-year", "6").collect()}
    assert {k[0] for k in plain} == {"close", "vol"} and plain.keys() == caps.keys()
    assert caps["close", "total", 2, "ann_ret"] != caps["close", "float", 2, "ann_ret"] and plain["close", "total", 2, "ann_ret"] == plain["close", "float", 2, "ann_ret"]
    assert caps["close", "equal", 2, "ann_ret"] == pytest.approx(plain["close", "equal", 2, "ann_ret"] / 2, abs=1e-4)
    assert {r.source for r in run("compare", "--panel", f"{tmp_path}/backtest", "--others", f"{tmp_path}/both").collect()} == {f"{tmp_path}/backtest", f"{tmp_path}/both"}
    assert cli.main(["manifest", "--out", f"{tmp_path}/m"], spark).count() == 7846
    (tmp_path / "raw.csv").write_text("PERMNO,HdrCUSIP,Ticker,PERMCO,DlyCalDt,DlyCap,DlyRet,DlyRetx,DlyVol,DlyClose,DlyLow,DlyHigh,DlyOpen\n7,a,b,1,2020-01-02,1,0.1,0.1,5,10,9,11,9.5\n")
    assert run("ingest", "--panel", f"{tmp_path}/raw.csv").first().asDict() == {"entity": 7, "date": dt.date(2020, 1, 2), "open": 9.5, "high": 11.0, "low": 9.0, "close": 10.0, "vol": 5.0, "ret": 0.1, "cap": 1.0, "total_cap": 1.0}


def test_tables_against_regressions_by_hand(spark):
    """A pooled logit against Newton's steps, and table rows against one regression at a time."""
    from tessera.plans import tables

    rng = np.random.default_rng(11)
    rows = []
    for m in range(8):
        for e in range(45):
            x = rng.normal(size=4)
            rows.append((e, dt.date(1995 + m // 4, 1 + m % 4, 1), *map(float, x), float(rng.normal() + 0.3 * x[0]), float(1 / (1 + math.exp(-rng.normal() - x[0])))))
    names = "entity long, date date, a double, b double, ret_5d double, ret_20d double, r60 double, p5 double"
    d = frame(spark, [(*r[:4], r[6], r[5], r[4], r[7]) for r in rows], names).withColumnRenamed("r60", "ret_60d").withColumns({"p20": F_col("p5") * 0.9, "p60": 1 - F_col("p5")})
    got = {(r.model, r.characteristic): r for r in tables.rank_correlations(d, ("a", "b")).collect()}
    assert len(got) == 6 and got["I5/R5", "a"].n == 8 and got["I5/R5", "a"].mean == pytest.approx(-got["I60/R5", "a"].mean) and got["I5/R5", "a"].t > 2
    logit = {(r.model, r.term): r.mean for r in tables.prediction_logit(d, ("a", "b")).collect()}
    assert set(logit) == {(m, t) for m in ("I5/R5", "I20/R5", "I60/R5") for t in ("const", "a", "b", "mcfadden_r2")} and logit["I5/R5", "a"] > 0
    before, after = d.where("date < date'1996-01-01'"), d.where("date >= date'1996-01-01'")
    ret = {(r.model, r.term): r.mean for r in tables.return_logit(after, before, ("a", "b")).collect()}
    assert len(ret) == 3 * (3 + 4 + 5) and all(v is not None for v in ret.values())
    spec = {(r.model, r.term) for r in tables.scaled_price_logit(after, before, ("a", "b")).collect()}
    assert {m for m, _ in spec} == {f"({i})" for i in range(1, 13)} and ("(12)", "p5") in spec and ("(10)", "a") not in spec and ("(11)", "oos_mcfadden_r2") in spec
    x = np.array([[1, r[2], r[3]] for r in rows])
    y = np.array([float(r[7] > 0.5) for r in rows])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    from pyspark.sql import functions as F

    assert regress.pooled_logit(d.withColumn("y", F.when(F.col("p5") > 0.5, 1).otherwise(0)), "y", ["a", "b"]) == pytest.approx(beta.tolist(), abs=1e-6)


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_streamed_bars_equal_the_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.streaming import windows

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").coalesce(1)
    e.write.parquet(f"{tmp_path}/events")
    q = windows.bars(windows.event_stream(spark, f"{tmp_path}/events")).writeStream.outputMode("append").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    out = spark.table("bars")
    last = out.agg(F.max("start")).first()[0]
    want = windows.bars(e).where(F.col("start") <= F.lit(last))
    assert out.count() == want.count() > 0 and out.exceptAll(want).count() == 0
