"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule: knots (t, weight) over training time 0..1, linear in between. The integral of
the schedule is the source's weight; a budget of words is shared by these weights, no source gets more than
``max_repeats`` times what it has, and what is cut there is shared again (water filling, in closed form). A source's
documents queue up in an order drawn from doc_id; a document's words fill an interval of its source's cumulative
demand, and inverting that demand gives its training position, by which the result is range-sorted.

Only DataFrame functions are used. Running sums over a source that holds a third of all rows do not meet in one task:
rows are summed by source and bucket of the order, only bucket sums are accumulated by source, and rows are accumulated
inside their bucket. There are 4,096 buckets, and more where a bucket would hold over ROWS rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SPACES = " \t\n\x0b\f\r"
#: Rows of a bucket, about, at most.
ROWS = 10_000
Knots = list[tuple[float, float]]
#: Integrals 3, 1 and 2: the first fades out, the second fades in, the third stays.
CURRICULUM: tuple[Knots, ...] = ([(0.0, 4.0), (1.0, 2.0)], [(0.0, 0.5), (1.0, 1.5)], [(0.0, 2.0), (1.0, 2.0)])


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    stripped = F.rtrim(text, F.lit(SPACES))
    return F.coalesce(F.length(F.regexp_replace(stripped, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")), F.lit(0)).cast("long")


def integral(knots: Knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def _segments(knots: Knots) -> Column:
    """The schedule's pieces: start, end, weight at the start, slope, and area before, as shares of the whole area."""
    area, out, before = integral(knots), [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append(F.struct(*(F.lit(float(v)).alias(n) for n, v in (("t", t0), ("w", w0 / area), ("k", (w1 - w0) / (t1 - t0) / area), ("a", before / area)))))
        before += (t1 - t0) * (w0 + w1) / 2
    return F.array(*out)


def _cyclic(rank: Column, values: list[Column]) -> Column:
    out = F.when(rank % len(values) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(rank % len(values) == i, v)
    return out


def source_targets(sizes: DataFrame, curriculum=CURRICULUM, share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """One row per source: its words, weight, schedule and target. ``sizes`` has source and size."""
    total = F.sum("source_size").over(Window.partitionBy())
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", (F.row_number().over(by_name) - 1).cast("long"))
    s = s.withColumn("weight", _cyclic(F.col("rank"), [F.lit(float(integral(k))) for k in curriculum]))
    s = s.withColumn("segments", _cyclic(F.col("rank"), [_segments(k) for k in curriculum]))
    s = s.withColumn("budget", F.lit(float(share)) * total.cast("double")).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    filling = Window.orderBy("ratio", "rank")
    s = s.withColumn("used", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("full", F.col("budget") - F.col("used") >= F.col("ratio") * F.col("left"))
    everywhere = Window.partitionBy()
    level = (F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everywhere)) / F.nullif(F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everywhere), F.lit(0.0))
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")))
    return s.select("source", "source_size", "segments", "target")


def _position(words: Column, target: Column, segments: Column) -> Column:
    """Training time at which a source's cumulative demand reaches ``words``."""
    share = F.least(words / F.nullif(target, F.lit(0.0)), F.lit(1.0))
    seg = F.element_at(F.filter(segments, lambda s: s["a"] <= share), -1)
    c = share - seg["a"]
    root = F.sqrt(seg["w"] * seg["w"] + 2 * seg["k"] * c)
    return seg["t"] + F.coalesce(2 * c / F.nullif(seg["w"] + root, F.lit(0.0)), F.lit(0.0))


def assign(docs: DataFrame, curriculum=CURRICULUM, share: float = 1.5, max_repeats: int = 2, whole: bool = False) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, copies (array of words and position per pass).

    A pass over a source that its target ends in the middle of a document takes that document's first words; with
    ``whole``, it takes the document if the target lies beyond its middle. Then ``taken`` is a multiple of size.

    Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, sorted
    last; a null doc_id queues by its text; rows with equal doc_id are rows of their own and ties between equal
    (doc_id, size) do not matter to the result; an empty table gives an empty table; further columns are ignored.
    """
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _queue().alias("queue")))
    d = _taken(sized, sized, ("queue", "doc_id", "size"), curriculum, share, max_repeats, whole)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda acc, c: acc + c["words"])
    return d.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies")


def _queue() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))


def _source_key() -> Column:
    """A source as a string that is never null, of one type wherever it is made, so that no join deals rows anew."""
    return F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))


def _taken(rows: DataFrame, sized: DataFrame, order: tuple[str, ...], curriculum, share: float, max_repeats: int, whole: bool) -> DataFrame:
    """``rows`` (source, size, queue and others) with source_size, target and copies; ``sized`` are the same rows, from
    which the sums of sources and buckets are taken. Rows of a bucket meet once and take their places by ``order``."""
    digits = max(3, math.ceil(math.log(max(sized.count(), 1) / ROWS, 16)))
    keyed = lambda d: d.withColumn("bucket", F.substring("queue", 1, digits)).withColumn("source_key", _source_key())
    bucket_sums = materialise(keyed(sized).groupBy("source_key", "bucket").agg(F.sum("size").alias("words")))
    sources = source_targets(bucket_sums.select(F.expr("CASE WHEN startswith(source_key, '1') THEN substring(source_key, 2) END").alias("source"), F.col("words").alias("size")), curriculum, share, max_repeats)
    sources = sources.select(_source_key().alias("source_key"), "source_size", "segments", "target")
    ahead = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead_of = bucket_sums.select("source_key", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before")).join(sources, "source_key")
    inside = Window.partitionBy("source_key", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = keyed(rows).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ahead_of, ["source_key", "bucket"])
    d = d.withColumn("start", F.col("before") + F.col("within"))
    copies = []
    for i in range(max_repeats):
        at = F.col("start") + i * F.col("source_size")
        if whole:
            words = F.when(2 * at + F.col("size") <= 2 * F.col("target"), F.col("size")).otherwise(F.lit(0))
        else:
            words = F.least(F.col("size"), F.greatest(F.floor("target") - at, F.lit(0)))
        words = words.cast("long")
        copies.append(F.struct(words.alias("words"), _position(at + F.col("size") / 2, F.col("target"), F.col("segments")).alias("position")))
    return d.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))


def mix(docs: DataFrame, curriculum=CURRICULUM, share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """The mixture itself: rows of ``docs`` (its own columns only), one per pass that takes them, in training order.

    Whole documents only. Every row has a place of its own: a source's words come within a document of its target.

    Defined cases: a null or empty text is never taken; null doc_ids and sources as in ``assign``; rows with equal
    doc_id queue by size, then by text; equal rows have places of their own, which are theirs in any order; an empty
    table gives an empty one; further columns are kept, whatever their names.
    """
    size, queue = word_count(F.col("text")).alias("size"), _queue().alias("queue")
    sized = materialise(docs.select("source", size, queue))
    rows = docs.select(F.struct("*").alias("row"), "source", size, queue, F.xxhash64("text").alias("tie")).where("size > 0")
    d = _taken(rows, sized, ("queue", "size", "tie"), curriculum, share, max_repeats, whole=True)
    return d.select("row", "queue", F.explode("copies.position").alias("position")).orderBy("position", "queue").select("row.*")
