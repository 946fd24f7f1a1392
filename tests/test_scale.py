"""Operators for entities, dates and tables that do not fit a task, against the plain ones."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.expr import rolling, with_extremes
from tessera.operators import xsection
from tessera.sources import io, store
from tessera.streaming import stateful


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(8)
    rows = []
    for e in range(6):
        for i in range((0, 1, 5, 30, 61, 200)[e]):
            x = rng.choice([None, 0.0, 1.0]) if rng.random() < 0.1 else round(rng.gauss(0, 1), 3)
            rows.append((e, dt.date(2020, 1, 1) + dt.timedelta(i * rng.choice([1, 1, 1])), x, round(rng.random(), 2)))
    return spark.createDataFrame(rows, "entity long, date date, close double, high double").cache()


def test_moving_extremes_of_any_length(spark, panel):
    wanted = {f"{k}{c}{n}b{back}": (k, c, n, back) for k in ("max", "min") for c in ("close", "high") for n in (1, 2, 5, 20, 60) for back in (0, 1, 3)}
    got = {(r.entity, r.date): r for r in with_extremes(panel, wanted).collect()}
    plain = panel.withColumns({name: rolling(F.max if k == "max" else F.min, c, -(n - 1) - back, -back) for name, (k, c, n, back) in wanted.items()})
    want = {(r.entity, r.date): r for r in plain.collect()}
    assert got == want and any(r["maxclose20b1"] is not None for r in want.values())


def test_extremes_need_no_shuffle_of_their_own(panel):
    d = with_extremes(panel.repartition(3, "entity"), {"a": ("max", "close", 252, 0), "b": ("min", "close", 20, 1)})
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_ranks_in_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(dt.date(2020, 1, d), rng.choice([None, float("nan"), 1.0, 1.0, 1.0, round(rng.gauss(0, 1), 1), rng.random()]), i) for d in (1, 2, 3) for i in range((150, 3, 1)[d - 1])]
    d = spark.createDataFrame(rows, "date date, signal double, entity long").withColumn("signal", F.when(~F.isnan("signal"), F.col("signal")))
    got = {(r.date, r.entity): (r.rank, r.rank_of) for r in xsection.ranked_in_ranges(d, "signal", ranges=ranges).collect()}
    want = {(r.date, r.entity): (r.a, r.n if r.a is not None else None) for r in d.select("*", xsection.average_rank("signal").alias("a"), F.count("signal").over(__import__("pyspark").sql.Window.partitionBy("date")).alias("n")).collect()}
    assert got == want


def _months(spark, n, extra=0.0):
    rows = [(e, dt.date(2020, 1 + m, 1 + e), float(e + m + (extra if m == 1 else 0))) for m in range(n) for e in range(5)]
    return spark.createDataFrame(rows, "entity long, date date, x double").withColumn("month", F.date_format("date", "yyyy-MM"))


def test_store_makes_what_is_pending(spark, tmp_path):
    path, made = f"{tmp_path}/sums", []

    def run(inputs, **options):
        s = store.Store(spark, path, "month", options)

        def make(keys):
            made.append(sorted(r.month for r in keys.collect()))
            return inputs.join(keys, "month", "left_semi").groupBy("month").agg((F.sum("x") * options["times"]).alias("s"))

        todo = s.update(inputs, make)
        return todo, {r.month: r.s for r in s.read().collect()}

    sums = lambda n, times, extra=0.0: {f"2020-{m + 1:02d}": times * sum(e + m + (extra if m == 1 else 0) for e in range(5)) for m in range(n)}
    assert run(_months(spark, 2), times=1) == (["2020-01", "2020-02"], sums(2, 1))
    assert run(_months(spark, 2).repartition(3), times=1) == ([], sums(2, 1))
    assert run(_months(spark, 3), times=1) == (["2020-03"], sums(3, 1))
    assert run(_months(spark, 3, 0.5), times=1) == (["2020-02"], sums(3, 1, 0.5))
    assert run(_months(spark, 3, 0.5), times=2)[0] == ["2020-01", "2020-02", "2020-03"]
    assert run(_months(spark, 3, 0.5), times=2) == ([], sums(3, 2, 0.5))
    assert run(_months(spark, 1), times=2) == ([], sums(1, 2))
    assert run(_months(spark, 2), times=2) == (["2020-02"], sums(2, 2))
    assert made == [["2020-01", "2020-02"], ["2020-03"], ["2020-02"], ["2020-01", "2020-02", "2020-03"], ["2020-02"]]


def test_store_after_a_run_that_was_cut_off(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/t", "month")
    inputs = _months(spark, 2)

    def fails(keys):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        s.update(inputs, fails)
    assert s.update(inputs, lambda keys: inputs) == ["2020-01", "2020-02"] and s.read().count() == 10


def test_resumed_with_other_options(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    path = f"{tmp_path}/t"
    assert io.resumed(spark, path, make, groups=5).count() == 1 and io.resumed(spark, path, make, groups=5).count() == 1
    assert io.resumed(spark, path, make, groups=10).count() == 2 and io.resumed(spark, path, make, groups=10).count() == 2
    assert io.resumed(spark, path, make, groups=5).count() == 3


def test_bucketed_panel_is_read_without_shuffles(spark, panel):
    from pyspark.sql import Window

    io.write_bucketed(panel, "bucketed_for_windows", 4)
    t = spark.table("bucketed_for_windows")
    w = Window.partitionBy("entity").orderBy("date")
    d = t.withColumn("before", F.lag("close").over(w)).join(t.groupBy("entity").agg(F.max("high").alias("top")).hint("merge"), "entity")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    plain = panel.withColumn("before", F.lag("close").over(w)).join(panel.groupBy("entity").agg(F.max("high").alias("top")), "entity")
    assert sorted(map(str, d.collect())) == sorted(map(str, plain.collect()))


def _bars(rng, n):
    rows = []
    for e in (1, 2, 3):
        price = 100.0
        for i in range(n):
            price = round(price * math.exp(rng.gauss(0, 0.05)), 4)
            rows.append((e, dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * i + e), price, float(rng.randrange(1, 9))))
    return rows


def test_stream_of_running_values_equals_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = _bars(rng, 60)
    schema = "entity long, ts timestamp, close double, vol double"
    # out of order within two days, and one bar that is far too late
    rows.sort(key=lambda r: r[1] + dt.timedelta(hours=rng.randrange(0, 40)))
    late = (1, dt.datetime(2024, 1, 1, 2), 5.0, 1.0)
    parts = [rows[i : i + 30] for i in range(0, len(rows), 30)]
    parts[4].append(late)
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:02d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = stateful.running(stream, "2 days", n=4, hold=3).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    d = spark.createDataFrame(rows, schema)
    edge = max(r[1] for r in rows) - dt.timedelta(days=2)
    want = sorted(map(tuple, stateful.batch(d, n=4, hold=3).where(F.col("ts") < F.lit(edge)).collect()))
    assert got == want and len(got) > 100 and {r[5] for r in got} == {-1, 0, 1}


def test_running_values_worked_by_hand():
    state, out = stateful.advance(stateful.START, [(1, 10.0, 5.0), (2, 11.0, 2.0), (3, 12.0, 1.0), (4, 9.0, 4.0), (5, 8.0, 1.0)], n=2, hold=2, decay=0.5)
    assert [(r[2], r[4]) for r in out] == [(0.0, 0), (2.0, 0), (3.0, 1), (-1.0, 1), (-2.0, -1)]
    assert [r[3] for r in out][:2] == [10.0, (11 + 5) / 1.5]
    again, rest = stateful.advance(stateful.START, [(1, 10.0, 5.0), (2, 11.0, 2.0)], 2, 2, 0.5)
    assert rest + stateful.advance(again, [(3, 12.0, 1.0), (4, 9.0, 4.0), (5, 8.0, 1.0)], 2, 2, 0.5)[1] == out
