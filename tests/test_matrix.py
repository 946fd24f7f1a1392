"""The packed matrix of rule positions against plain per-rule rankings."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.expr import compounded
from tessera.operators import portfolio, rules
from tessera.plans import pipelines


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(4)
    rows, day = [], dt.date(2020, 1, 1)
    for e in range(25):
        price = 50.0
        for i in range(260):
            price *= math.exp(rng.gauss(0, 0.03))
            if rng.random() > 0.1:
                rows.append((e, day + dt.timedelta(i), price, float(rng.randrange(1, 99)), price * 10 if e != 3 else None))
    d = spark.createDataFrame(rows, "entity long, date date, close double, vol double, cap double")
    w = Window.partitionBy("entity").orderBy("date")
    return d.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).cache()


def test_cells_survive_packing():
    rng = np.random.default_rng(1)
    for n, r in ((5, 1), (3, 4), (7, 1030)):
        pos = rng.integers(-1, 2, (n, r)).astype(np.int8)
        cells = rules.unpack_cells(rules.pack_cells(pos))
        assert (cells[:, :r] == pos + 1).all() and (cells[:, r:] == rules.NONE).all()


def _ranked(cells, ret, w, groups):
    """One rule by the plain definition: z score, clip, z score, rank with ties in order, weighted legs."""
    at = [i for i, c in enumerate(cells) if c < 3]
    if len(at) < groups:
        return math.nan
    s = np.array([cells[i] - 1.0 for i in at])
    for clip in (True, False):
        if s.std(ddof=1) == 0:
            return math.nan
        s = (s - s.mean()) / s.std(ddof=1)
        s = np.clip(s, -3, 3) if clip else s
    order = sorted(range(len(at)), key=lambda k: (round(s[k], 12), k))
    legs = {1: [], groups: []}
    for rank, k in enumerate(order):
        g = rank * groups // len(at) + 1
        if g in legs and w[at[k]] > 0:
            legs[g].append(at[k])
    if not legs[1] or not legs[groups]:
        return math.nan
    mean = lambda ids: sum(w[i] * ret[i] for i in ids) / sum(w[i] for i in ids)
    return mean(legs[groups]) - mean(legs[1])


@pytest.mark.parametrize(("n", "groups"), [(40, 5), (12, 3), (4, 5), (200, 10)])
def test_ranks_follow_from_counts(n, groups):
    rng = np.random.default_rng(n)
    odds = [(0.3, 0.3, 0.3, 0.1), (0.0, 0.98, 0.01, 0.01), (0.98, 0.01, 0.01, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.1, 0.0, 0.9), (0.5, 0.0, 0.5, 0.0)]
    cells = np.stack([rng.choice(4, n, p=p) for p in odds for _ in range(6)], axis=1).astype(np.uint8)
    ret, w = rng.normal(size=n), np.stack([np.ones(n), np.where(rng.random(n) < 0.3, 0.0, rng.random(n)), np.zeros(n)])
    got = portfolio.cells_high_low(cells, ret, w, groups)
    for s in range(3):
        for j in range(cells.shape[1]):
            want = _ranked(cells[:, j], ret, w[s], groups)
            assert (math.isnan(want) and math.isnan(got[s, j])) or got[s, j] == pytest.approx(want), (s, j)


def test_matrix_matches_the_long_operator(spark, panel, monkeypatch):
    monkeypatch.setattr(portfolio, "CELLS", 500)
    chosen = random.Random(1).sample(rules.manifest(), 40)
    got = {(r.rule_id, r.scheme, r.date): r.hl for r in pipelines.rule_returns(panel, chosen, 20, 5).collect()}
    last = Window.partitionBy("entity", F.date_trunc("month", "date")).orderBy(F.desc("date"))
    at = panel.withColumn("r20", compounded("ret", 1, 20)).withColumn("n", F.row_number().over(last)).where("n = 1").select("entity", "date", F.to_date(F.date_trunc("month", "date")).alias("period"), F.col("r20").alias("ret"), "cap")
    pos = rules.positions(panel, chosen, at).join(at, ["entity", "date"]).withColumn("date", F.col("period")).withColumn("pos", F.col("pos").cast("double"))
    want = {(r.rule_id, r.scheme, r.date): r.hl for r in portfolio.rule_high_low(pos, 5).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_every_rule_has_its_rows(spark, panel):
    chosen = rules.manifest()[::250]
    members = pipelines.rule_universe(panel, 20, "2020-03-01", entity_limit=12)
    assert members.select("entity").distinct().count() == 12 and members.where("date < '2020-03-01'").count() == 0
    got = pipelines.rule_scan(panel, chosen, 20, 5, members).collect()
    assert len(got) == 3 * len(chosen) and {(r.rule_id, r.scheme) for r in got} == {(r.rule_id, s) for r in chosen for s in ("equal", "float", "total")}
    silent = [r for r in got if r.n_periods == 0]
    assert silent and all(r.sharpe is None and r.ann_ret is None for r in silent) and any(r.sharpe is not None for r in got)
    with pytest.raises(ValueError):
        pipelines.rule_universe(panel, 20, "2030-01-01")


def test_plan_does_not_broadcast_positions(panel):
    as_of = panel.select("entity", "date")
    plan = rules.sampled(panel, rules.manifest()[:3], as_of)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < (plan.index("Join") if "Join" in plan else len(plan))


def test_as_of_rows_without_a_session(spark, panel):
    as_of = panel.where("entity = 1").select("entity", "date").unionByName(spark.sql("SELECT CAST(1 AS long) AS entity, DATE '2031-01-01' AS date UNION ALL SELECT CAST(99 AS long), DATE '2020-02-02'"))
    chosen = rules.manifest()[:2]
    got = {(r.entity, r.date, r.rule_id): r.pos for r in rules.sampled(panel, chosen, as_of).collect()}
    plain = {(r.entity, r.date, r.rule_id): r.pos for r in rules.positions(panel.where("entity = 1"), chosen).collect()}
    gone = {k: v for k, v in got.items() if k not in plain}
    assert len(gone) == 4 and set(gone.values()) == {None} and {k: got[k] for k in plain} == plain


def test_sharpe_distribution(spark):
    rows = [("equal", x) for x in (0.0, 0.5, 1.0, 1.0, None, float("nan"))] + [("float", 2.0), ("float", 2.0)]
    d = spark.createDataFrame(rows, "scheme string, sharpe double")
    got = sorted(map(tuple, portfolio.sharpe_distribution(d, 4, 3.0).collect()))
    assert got == [("equal", 1, 1, 0.0, 0.25, -0.15000000000000002, 3.15), ("equal", 3, 1, 0.5, 0.75, -0.15000000000000002, 3.15), ("equal", 4, 2, 0.75, 1.0, -0.15000000000000002, 3.15), ("float", 3, 2, 2.0, 2.25, 1.95, 3.05)]
    alone = portfolio.sharpe_distribution(d.where("scheme = 'float'"), 4).first()
    assert (alone.x_lo, alone.x_hi) == (1.5, 2.5)
