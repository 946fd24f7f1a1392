"""Report tables, as long frames that a sink may pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import PERIODS_PER_YEAR
from .portfolio import HIGH_LOW


def group_label(grp: Column) -> Column:
    return F.when(grp == HIGH_LOW, "DH").otherwise(F.format_string("D%02d", grp))


def monthly_turnover(annual: Column, horizon: int) -> Column:
    """Percent per month from annualised two-way turnover: a period is horizon / 20 months."""
    return annual / PERIODS_PER_YEAR[horizon] / (horizon / 20) * 100


def decile_curve(perf: DataFrame, metric: str = "ann_ret") -> DataFrame:
    """Value by group, high minus low left out."""
    return perf.where((F.col("metric") == metric) & (F.col("grp") != HIGH_LOW)).select("scheme", "grp", group_label(F.col("grp")).alias("label"), "value")


def overview(perf: DataFrame, groups: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows in report order: returns, ratio, drawdown and turnover of high minus low, then the outer groups' returns."""
    rows = [("ret", "ann_ret", HIGH_LOW), ("ir", "info_ratio", HIGH_LOW), ("max_dd", "max_dd", HIGH_LOW), ("to", "turnover", HIGH_LOW), ("d_low", "ann_ret", 1), ("d_high", "ann_ret", groups)]
    place = F.lit(None).cast("int")
    name = F.lit(None).cast("string")
    for i, (n, m, g) in enumerate(rows):
        hit = (F.col("metric") == m) & (F.col("grp") == g)
        place, name = F.when(hit, i).otherwise(place), F.when(hit, n).otherwise(name)
    return perf.withColumns({"place": place, "row": name}).where("place is not null").select(*keys, "scheme", "place", "row", "value").orderBy(*keys, "scheme", "place")


def compare(tables: dict[str, DataFrame], metrics: tuple[str, ...] = ("ann_ret", "sharpe", "turnover")) -> DataFrame:
    """High-minus-low metrics of several sources side by side, long."""
    out = None
    for source, perf in tables.items():
        d = perf.where((F.col("grp") == HIGH_LOW) & F.col("metric").isin(*metrics)).select(F.lit(source).alias("source"), "scheme", "metric", "value")
        out = d if out is None else out.unionByName(d)
    return out


def parsed_cell(text: Column) -> tuple[Column, Column]:
    """Number and stars of a cell such as ``5.85***``; NULL and no stars where it is none."""
    pattern = r"^([-+]?\d*\.?\d+)(\**)$"
    number = F.regexp_extract(text, pattern, 1)
    return F.when(number != "", number.cast("double")), F.regexp_extract(text, pattern, 2)


def portfolio_table(tables: dict[int, DataFrame], metrics: tuple[str, ...] = ("ann_ret", "sharpe")) -> DataFrame:
    """Groups by horizon: all rows of the first horizon, high minus low of the others."""
    out = None
    for h, perf in tables.items():
        d = perf.where(F.col("metric").isin(*metrics))
        if h != 1:
            d = d.where(F.col("grp") == HIGH_LOW)
        d = d.select(F.lit(h).alias("horizon"), "scheme", group_label(F.col("grp")).alias("label"), "metric", "value")
        out = d if out is None else out.unionByName(d)
    return out
