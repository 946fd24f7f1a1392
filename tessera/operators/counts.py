"""Counts that can be merged: several groupings in one pass, and distinct values by sketches kept for each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by_sets(rows: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """Row counts for each of several groupings, in one aggregation; columns that a grouping leaves out are NULL and
    ``level`` is the number that SQL's GROUPING_ID gives it."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id(*columns).cast("int").alias("level"), F.count("*").alias("n"))


def sketches(rows: DataFrame, shard: list[str], columns: tuple[str, ...], lg: int = 12) -> DataFrame:
    """Per shard: row count and a HyperLogLog sketch (2^lg registers) of each column's distinct values, to be stored."""
    return rows.groupBy(*shard).agg(F.count("*").alias("n"), *(F.hll_sketch_agg(F.col(c).cast("string"), lg).alias(f"{c}_sketch") for c in columns))


def merged(stored: DataFrame, by: list[str | Column], columns: tuple[str, ...]) -> DataFrame:
    """Sums of counts and estimates of distinct values over the stored shards of each key; no row is read again."""
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), *(F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(f"n_{c}") for c in columns))


def relative_error(lg: int = 12) -> float:
    """Standard error of an estimate from 2^lg registers."""
    return 1.04 / 2 ** (lg / 2)
