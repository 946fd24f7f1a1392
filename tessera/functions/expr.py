"""Null rules and window frames shared by all operators.

A missing value is NULL: NaN and infinities become NULL where data enter, since Spark's aggregates skip NULL only.
Rolling statistics are NULL unless their whole window is there and without gaps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value, or NULL if it is NaN or infinite."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def log1p_safe(r: Column | str) -> Column:
    """log(1 + r), NULL where a return is -100 % or less."""
    return F.when(col(r) > -1, F.log1p(col(r)))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))


def by_entity(entity: str = "entity", date: str = "date") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(date)


def by_date(date: str = "date") -> WindowSpec:
    return Window.partitionBy(date)


def rolling(agg: Callable[[Column], Column], c: Column | str, first: int, last: int, window: WindowSpec | None = None) -> Column:
    """``agg`` over rows ``first`` to ``last`` around the current one, NULL unless all of them hold a value."""
    frame = (window or by_entity()).rowsBetween(first, last)
    c = col(c)
    return F.when(F.count(c).over(frame) == last - first + 1, agg(c).over(frame))


def prefixed(panel: DataFrame, columns: dict[str, Column], window: WindowSpec | None = None) -> DataFrame:
    """``panel`` with running sums and counts of ``columns``, from which ``window_sum`` takes any window in constant time
    a row, where a sliding frame adds up all of its rows again."""
    w = (window or by_entity()).rowsBetween(Window.unboundedPreceding, 0)
    d = panel
    for name, c in columns.items():
        d = d.withColumns({f"__s_{name}": F.coalesce(F.sum(c).over(w), F.lit(0.0)), f"__n_{name}": F.count(c).over(w)})
    return d


def window_sum(name: str, n: int, window: WindowSpec | None = None) -> Column:
    """Sum of a ``prefixed`` column over the last ``n`` rows, NULL unless all of them hold a value."""
    w = window or by_entity()
    before = lambda c, none: F.coalesce(F.lag(f"{c}_{name}", n).over(w), F.lit(none))
    whole = F.col(f"__n_{name}") - before("__n", 0) == n
    return F.when(whole, F.col(f"__s_{name}") - before("__s", 0.0))


def with_extremes(panel: DataFrame, wanted: dict[str, tuple[str, str, int, int]], entity: str = "entity", date: str = "date") -> DataFrame:
    """``panel`` with moving extremes ``{name: (max or min, column, n, back)}``: over ``n`` own rows that end ``back`` rows
    before the present one, NULL unless all of them hold a value.

    An entity's rows are cut into blocks of n. A window reaches over two of them, so its extreme is that of the end of the
    one from its first row on and of the beginning of the other up to its last: two running extremes and one comparison
    a row, whatever n is. Nothing is shuffled beyond the entity's own windows.
    """
    own = by_entity(entity, date)
    running = own.rowsBetween(Window.unboundedPreceding, 0)
    kinds = {"max": (F.max, F.greatest), "min": (F.min, F.least)}
    d = panel.withColumns({"__i": F.row_number().over(own) - 1} | {f"__have_{c}": F.count(c).over(running) for _, c, _, _ in wanted.values()})
    for n in sorted({n for _, _, n, _ in wanted.values()}):
        d = d.withColumn("__block", F.floor(F.col("__i") / n))
        block = Window.partitionBy(entity, "__block")
        pairs = sorted({(kind, c) for kind, c, m, _ in wanted.values() if m == n})
        for side, order in (("from", F.col(date)), ("upto", F.col(date).desc())):
            w = block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
            d = d.withColumns({f"__{side}_{kind}_{c}_{n}": kinds[kind][0](c).over(w) for kind, c in pairs})
    out = {}
    for name, (kind, c, n, back) in wanted.items():
        there = lambda k: F.lag(f"__have_{c}", k).over(own) if k else F.col(f"__have_{c}")  # noqa: E731, B023
        whole = there(back) - F.coalesce(there(n + back), F.lit(0)) == n
        last = F.lag(f"__from_{kind}_{c}_{n}", back).over(own) if back else F.col(f"__from_{kind}_{c}_{n}")
        reach = n - 1 + back
        first = F.lag(f"__upto_{kind}_{c}_{n}", reach).over(own) if reach else F.col(f"__upto_{kind}_{c}_{n}")
        out[name] = F.when(whole, kinds[kind][1](first, last))
    return d.withColumns(out).select(*panel.columns, *wanted)


def without_prefixes(panel: DataFrame) -> DataFrame:
    return panel.drop(*(c for c in panel.columns if c.startswith(("__s_", "__n_"))))


def compounded(r: Column | str, first: int, last: int, window: WindowSpec | None = None) -> Column:
    """Compounded return over rows ``first`` to ``last``."""
    return F.expm1(rolling(F.sum, log1p_safe(r), first, last, window))


def half_away(c: Column | str, digits: int) -> Column:
    """Rounded to ``digits``, halves away from zero, as SQL engines do it: the scaled double is rounded. ``F.round`` goes by
    the shortest decimal that names the double, and differs where the product is a half and the decimal is not."""
    return F.round(col(c) * 10.0**digits, 0) / 10.0**digits


def half_even(c: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.bround(c, 0)
