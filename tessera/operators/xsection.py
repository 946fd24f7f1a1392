"""Cross-sectional operators: per date over all entities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..deploy import ship
from ..functions.expr import clip, finite, safe_div

#: Pairs that a date needs to count (fixed value).
LEAST_PAIRS = 30


def zscore(c: Column, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    return safe_div(c - F.avg(c).over(w), F.stddev_samp(c).over(w))


def standardised(panel: DataFrame, signal: str = "signal", by: tuple[str, ...] = ("date",), out: str | None = None) -> DataFrame:
    """z score, clipped to 3, z score again; rows without a value, and constant cross-sections, become NULL."""
    d = panel.withColumn("__z", clip(zscore(finite(signal), list(by)), -3.0, 3.0))
    # least/greatest skip NULL, so a missing score must stay missing
    d = d.withColumn("__z", F.when(zscore(finite(signal), list(by)).isNotNull(), F.col("__z")))
    return d.withColumn(out or signal, zscore(F.col("__z"), list(by))).drop("__z")


def quantile_groups(panel: DataFrame, groups: int = 10, signal: str = "signal", by: tuple[str, ...] = ("date",), thin: str = "raise") -> DataFrame:
    """Groups 1 to ``groups`` by rank, ties in order of entity; dates with fewer names than groups raise, or with ``thin``
    "drop" they are left out."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    d = panel.withColumn("__n", n)
    if thin == "drop":
        d = d.where(F.col("__n") >= groups)
    elif thin == "raise":
        d = d.withColumn("__n", F.when(F.col("__n") < groups, F.raise_error(F.concat(F.lit(f"fewer than {groups} names at "), F.concat_ws(", ", *(F.col(c).cast("string") for c in by)))).cast("long")).otherwise(F.col("__n")))
    else:
        raise ValueError(f"thin is raise or drop, not {thin}")
    rank = F.row_number().over(w.orderBy(signal, "entity"))
    g = F.least(F.lit(groups), F.floor((rank - 1) * groups / F.col("__n")) + 1)
    return d.withColumn("grp", g.cast("int")).drop("__n")


def group_name(grp: Column) -> Column:
    return F.format_string("D%02d", grp)


def average_rank(signal: str, by: tuple[str, ...] = ("date",)) -> Column:
    """Rank from 1 with ties averaged; NULL for NULL."""
    w = Window.partitionBy(*by)
    rank = F.rank().over(w.orderBy(F.col(signal).asc_nulls_last()))
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, signal))
    return F.when(F.col(signal).isNotNull(), rank + (same - 1) / 2)


def percentile_rank(signal: str, by: tuple[str, ...] = ("date",)) -> Column:
    """Average rank over the number of values, in (0, 1]."""
    return average_rank(signal, by) / F.count(signal).over(Window.partitionBy(*by))


def ranked_in_ranges(panel: DataFrame, signal: str, by: tuple[str, ...] = ("date",), ranges: int = 64, out: str = "rank") -> DataFrame:
    """``average_rank`` and the number of values (``<out>`` and ``<out>_of``) where one cross-section may hold more names
    than a task should sort; NULL for NULL.

    Values are counted first, so a value that most names share is one row. Approximate quantiles cut a cross-section's
    values into ranges (any cuts give the same ranks: a value lies in one range whole). They depend on the order in which
    sketches merge and are read twice, so they are made once and held, a row a date; ranges are counted, a value's place inside its range is a running sum there, and what lies in the ranges before it is added.
    """
    value = finite(signal)
    d = panel.withColumn("__v", value)
    counts = d.where("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx("__v", [i / ranges for i in range(1, ranges)], 1000).alias("__cuts")).persist()
    # how many cuts lie at or below a value
    counts = counts.join(cuts, list(by)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c <= F.col("__v")))).drop("__cuts")
    whole = counts.groupBy(*by, "__range").agg(F.sum("__n").alias("__size"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*by, "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"), F.sum("__size").over(Window.partitionBy(*by)).alias("__of"))
    inside = Window.partitionBy(*by, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("__upto", F.sum("__n").over(inside)).join(whole, [*by, "__range"])
    placed = placed.select(*by, "__v", (F.col("__offset") + F.col("__upto") - (F.col("__n") - 1) / 2).alias(out), F.col("__of").alias(f"{out}_of"))
    return d.join(placed, [*by, "__v"], "left").select(*panel.columns, out, f"{out}_of")


def percentile_ranks(panel: DataFrame, columns: list[str], by: tuple[str, ...] = ("date",)) -> DataFrame:
    """``percentile_rank`` of many columns at once: a cross-section meets once, where a window would sort it for each
    column. Missing values stay missing."""
    ship(panel.sparkSession)
    schema = StructType([StructField(f.name, DoubleType()) if f.name in columns else f for f in panel.schema.fields])

    def run(table: pa.Table) -> pa.Table:
        for c in columns:
            x = np.asarray(table[c].cast(pa.float64()).to_numpy(zero_copy_only=False), float)
            there = np.isfinite(x)
            _, of, n = np.unique(x[there], return_inverse=True, return_counts=True)
            rank = np.full(len(x), np.nan)
            rank[there] = (np.cumsum(n) - (n - 1) / 2)[of] / max(there.sum(), 1)
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(rank, from_pandas=True))
        return table

    return panel.groupBy(*by).applyInArrow(run, schema)


def spearman(panel: DataFrame, x: str, y: str, least: int = LEAST_PAIRS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rank correlation per date (and ``keys``) over rows that have both values."""
    by = (*keys, "date")
    d = panel.where(finite(x).isNotNull() & finite(y).isNotNull()).select(*by, x, y)
    d = d.withColumn("__a", average_rank(x, by)).withColumn("__b", average_rank(y, by))
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp("__a").alias("__sa"), F.stddev_samp("__b").alias("__sb"), F.covar_samp("__a", "__b").alias("__c"))
    return g.where(F.col("n") >= least).select(*by, F.col("n").cast("long").alias("n"), safe_div("__c", F.col("__sa") * F.col("__sb")).alias("rho"))


def scheme_weight(scheme: Column | str, float_cap: str = "cap", total_cap: str = "cap") -> Column:
    """1 for equal weights, else the scheme's cap if it is positive, or NULL."""
    scheme = F.lit(scheme) if isinstance(scheme, str) else scheme
    pos = lambda c: F.when(finite(c) > 0, finite(c))
    return F.when(scheme == "equal", F.lit(1.0)).when(scheme == "float", pos(float_cap)).when(scheme == "total", pos(total_cap))


def market_return(panel: DataFrame) -> DataFrame:
    """Cap-weighted mean return per date, caps of the same date."""
    d = panel.where(finite("ret").isNotNull() & (finite("cap") > 0))
    return d.groupBy("date").agg(safe_div(F.sum(F.col("cap") * F.col("ret")), F.sum("cap")).alias("mkt_ret"))


def binary_target(c: Column, above: float = 0.0) -> Column:
    return F.when(c.isNotNull(), F.when(c > above, 1).otherwise(0))
