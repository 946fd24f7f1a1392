"""``python -m tessera VERB --panel PATH --out PATH [options]``: a run per verb, from tables to tables.

A panel has entity, date, open, high, low, close, vol, cap, ret. Results that exist are
read and not made again, if they were made with the same options.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import report, rules, universe
from .plans import pipelines, tables
from .sources import io


def labels(spark: SparkSession, panel: DataFrame, o: argparse.Namespace) -> DataFrame:
    """Daily labels of all horizons, for a universe's members where one is named."""
    members = io.read_table(spark, o.universe) if o.universe else None
    return pipelines.prepare_labels(panel, members, o.entity_limit)


def images(spark: SparkSession, panel: DataFrame, o: argparse.Namespace) -> DataFrame:
    """Charts with labels of one window and horizon."""
    made = pipelines.build_images(panel, (o.window,), (o.horizon,), cross=True)
    return made[o.window, o.horizon]


def ingest(spark: SparkSession, panel: DataFrame, o: argparse.Namespace) -> DataFrame:
    """A daily price file, of the first source or with ``--source dsf`` of the second, as a panel."""
    if o.source == "dsf":
        d, float_cap, total_cap = io.map_dsf(panel), "DlyFloatCap", "DlyTotalCap"
    else:
        d, float_cap, total_cap = io.read_ohlc_csv(spark, o.panel), "DlyCap", "DlyCap"
    names = {"open": "DlyOpen", "high": "DlyHigh", "low": "DlyLow", "close": "DlyClose", "vol": "DlyVol", "ret": "DlyRet", "cap": float_cap, "total_cap": total_cap}
    return d.select(F.col("PERMNO").alias("entity"), F.col("DlyCalDt").alias("date"), *(F.col(c).alias(n) for n, c in names.items()))


def manifest(spark: SparkSession, panel: DataFrame | None, o: argparse.Namespace) -> DataFrame:
    """The technical rules with their parameters."""
    return rules.manifest_frame(spark)


def compare(spark: SparkSession, panel: DataFrame, o: argparse.Namespace) -> DataFrame:
    """High-minus-low metrics of a stored performance table and of others, side by side."""
    return report.compare({path: io.read_performance(spark, path) for path in (o.panel, *o.others)})


def table(spark: SparkSession, panel: DataFrame, o: argparse.Namespace) -> DataFrame:
    """A characteristic table from a month-end panel, those of returns split at ``--split``."""
    before, after = panel.where(F.col("date") < F.lit(o.split).cast("date")), panel.where(F.col("date") >= F.lit(o.split).cast("date"))
    return {"correlation": lambda: tables.rank_correlations(panel), "prediction": lambda: tables.prediction_logit(panel), "returns": lambda: tables.return_logit(after, before), "prices": lambda: tables.scaled_price_logit(after, before)}[o.table]()


def _options(o: argparse.Namespace) -> dict:
    return {"groups": o.groups, "direct": o.direct, "thin": o.thin}


def _caps(o: argparse.Namespace) -> dict:
    return {"float_cap": o.float_cap, "total_cap": o.total_cap}


def _member_rows(spark: SparkSession, panel: DataFrame, o: argparse.Namespace) -> DataFrame:
    return universe.to_universe(panel, io.read_table(spark, o.universe), must=True) if o.universe else panel


def backtest(spark: SparkSession, panel: DataFrame, o: argparse.Namespace) -> DataFrame:
    """Performance of one signal column, or several in one plan, at period ends."""
    d = panel.withColumn("ret_ahead", pipelines.compounded("ret", 1, o.horizon))
    d = pipelines.as_of_rows(_member_rows(spark, d, o), o.horizon)
    made = {s: d.select("entity", "date", F.col(s).alias("signal"), F.col("ret_ahead").alias("ret"), *dict.fromkeys((o.float_cap, o.total_cap))) for s in o.signal}
    return pipelines.backtests(made, o.horizon, top_n=o.top_n, start=o.start, eval_horizons=tuple(o.eval_horizons), periods_per_year=o.periods_per_year, **_options(o), **_caps(o))


def benchmark(spark: SparkSession, panel: DataFrame, o: argparse.Namespace) -> DataFrame:
    """Performance of momentum, the reversals and the score of the averages."""
    made = {n: _member_rows(spark, d, o) for n, d in pipelines.benchmark_signals(panel, o.horizon, own=o.own_ends).items()}
    return pipelines.backtests(made, o.horizon, top_n=o.top_n, start=o.start, eval_horizons=tuple(o.eval_horizons), periods_per_year=o.periods_per_year, **_options(o))


def holding(spark: SparkSession, panel: DataFrame, o: argparse.Namespace) -> DataFrame:
    """Performance of the first five days of a month's holding period and of the days after them."""
    d = panel.withColumns({"r5": pipelines.compounded("ret", 1, 5), "r20": pipelines.compounded("ret", 1, 20)})
    d = pipelines.as_of_rows(_member_rows(spark, d, o), 20)
    return pipelines.holding_breakdown({s: d.select("entity", "date", F.col(s).alias("signal"), "r5", "r20", "cap") for s in o.signal}, "r5", "r20", **_options(o))


def scan(spark: SparkSession, panel: DataFrame, o: argparse.Namespace) -> DataFrame:
    """Sharpe ratios of the technical rules, all or the first ones, inside a universe where one is named, or, with
    ``--start``, among the rows that have a history and a return ahead."""
    members = io.read_table(spark, o.universe) if o.universe else pipelines.rule_universe(panel, o.horizon, o.start, o.entity_limit) if o.start or o.entity_limit else None
    return pipelines.rule_scan(panel, rules.manifest()[: o.rules], o.horizon, o.groups, members, **_caps(o))


VERBS: dict[str, Callable[[SparkSession, DataFrame, argparse.Namespace], DataFrame]] = {f.__name__: f for f in (ingest, labels, images, backtest, benchmark, holding, scan, table, compare, manifest)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("--panel", help="table of daily rows; a price file for ingest, a month-end panel for table, a performance table for compare")
    p.add_argument("--out", required=True, help="folder of the result")
    p.add_argument("--universe", help="table of members: entity, date")
    p.add_argument("--entity-limit", type=int, help="the first entities only")
    p.add_argument("--signal", default=["ret"], nargs="+", help="columns that are ranked, each a model")
    p.add_argument("--float-cap", default="cap", help="column that weighs scheme float")
    p.add_argument("--total-cap", default="cap", help="column that weighs scheme total and chooses the largest names")
    p.add_argument("--periods-per-year", type=int, help="for annual figures; by default those of the horizon")
    p.add_argument("--own-ends", action="store_true", help="benchmark signals at each name's last session of a period")
    p.add_argument("--source", default="ohlc", choices=("ohlc", "dsf"))
    p.add_argument("--others", nargs="*", default=[], help="performance tables to compare with")
    p.add_argument("--table", default="correlation", choices=("correlation", "prediction", "returns", "prices"))
    p.add_argument("--split", default=tables.SPLIT, help="first test date of a table")
    p.add_argument("--window", type=int, default=5, choices=(5, 20, 60))
    p.add_argument("--horizon", type=int, default=20, choices=(5, 20, 60))
    p.add_argument("--eval-horizons", type=int, nargs="+", default=[1], help="holding periods after the signal")
    p.add_argument("--groups", type=int, default=10)
    p.add_argument("--top-n", type=int, help="largest names by cap at each date")
    p.add_argument("--start", help="first date")
    p.add_argument("--direct", action="store_true", help="rank the signal as it is")
    p.add_argument("--thin", default="raise", choices=("raise", "drop"), help="dates with fewer names than groups")
    p.add_argument("--rules", type=int, help="the first rules only")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    o = parser().parse_args(argv)
    if not o.panel and o.verb != "manifest":
        raise SystemExit("--panel is missing")
    spark = spark or SparkSession.builder.appName(f"tessera-{o.verb}").getOrCreate()
    panel = lambda: None if o.verb in ("manifest", "compare") or (o.verb, o.source) == ("ingest", "ohlc") else io.read_table(spark, o.panel)
    return io.resumed(spark, o.out, lambda: VERBS[o.verb](spark, panel(), o), **{k: v for k, v in vars(o).items() if k != "out"})


if __name__ == "__main__":
    main()
