"""Filters, predicates and universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import by_entity, finite

#: Prefixes of codes of foreign-currency share classes, and the pattern of names under special treatment (fixed values).
FOREIGN_PREFIXES = ("200", "900")
SPECIAL_TREATMENT = r"(?i)ST|\*ST|退|退市"


def zero_padded(code: Column, width: int = 6) -> Column:
    """Left-padded with zeros; longer codes stay whole."""
    c = F.trim(code.cast("string"))
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def code_to_id(code: Column) -> Column:
    return F.trim(code.cast("string")).cast("long")


def has_prefix(code: Column, prefixes=FOREIGN_PREFIXES) -> Column:
    return F.coalesce(F.substring(code, 1, len(prefixes[0])).isin(*prefixes), F.lit(False))


def matches(name: Column, pattern: str = SPECIAL_TREATMENT) -> Column:
    """Whether a pattern occurs; missing and blank names do not match."""
    return F.coalesce(name.rlike(pattern) & (F.trim(name) != ""), F.lit(False))


def in_industry(code: Column, name: Column, codes: tuple[str, ...], parts: tuple[str, ...]) -> Column:
    """Industry by code, or by a part of its name."""
    out = F.coalesce(code.isin(*codes), F.lit(False))
    for p in parts:
        out = out | F.coalesce(name.contains(p), F.lit(False))
    return out


def eligible(*excluded: Column) -> Column:
    """None of the exclusions holds."""
    out = F.lit(True)
    for e in excluded:
        out = out & ~F.coalesce(e, F.lit(False))
    return out


def to_universe(panel: DataFrame, membership: DataFrame, mask: Column | None = None, must: bool = False) -> DataFrame:
    """Rows whose (entity, date) is a member, then the mask; ``must``: raises ``ValueError`` where none is left."""
    out = panel.join(membership.select("entity", "date").distinct(), ["entity", "date"], "left_semi")
    out = out if mask is None else out.where(mask)
    if must and out.isEmpty():
        raise ValueError("no row of the panel lies in the universe")
    return out


def ever_member(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """The whole history of every entity that was a member at any time."""
    return panel.join(membership.select("entity").distinct(), "entity", "left_semi")


def positive(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(finite(c) > 0, F.lit(False))
    return out


def without_missing(panel: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinities become NULL, then rows that lack a value go."""
    return panel.withColumns({c: finite(c) for c in columns}).dropna(subset=list(columns))


def first_entities(panel: DataFrame, k: int) -> DataFrame:
    return panel.join(panel.select("entity").distinct().orderBy("entity").limit(k), "entity", "left_semi")


def top_by_cap(panel: DataFrame, n: int, cap: str = "cap") -> DataFrame:
    """The n largest per date; ties go to the smaller entity."""
    w = Window.partitionBy("date").orderBy(F.col(cap).desc_nulls_last(), "entity")
    return panel.where(positive(cap)).withColumn("cap_rank", F.row_number().over(w)).where(F.col("cap_rank") <= n)


def labelled(panel: DataFrame, column: str) -> DataFrame:
    return panel.where(F.col(column).isin(0, 1))


def without_final_rows(panel: DataFrame) -> DataFrame:
    """Without the last row of entities that end before the market's calendar does."""
    last_day = panel.agg(F.max("date").alias("__calendar_last"))
    own_last = F.max("date").over(Window.partitionBy("entity"))
    d = panel.withColumn("__last", own_last).crossJoin(F.broadcast(last_day))
    return d.where(~((F.col("date") == F.col("__last")) & (F.col("date") < F.col("__calendar_last")))).drop("__last", "__calendar_last")


def with_history(panel: DataFrame, n: int) -> DataFrame:
    """Rows that have at least n own sessions up to and with their own."""
    return panel.withColumn("__n", F.row_number().over(by_entity())).where(F.col("__n") >= n).drop("__n")
