"""Quality classification by importance resampling.

Two generative models over hashed n-grams (words and word pairs, 2^16 buckets each) are estimated: one from target
documents, those labelled good, and one from raw text, which is all documents. A document's log importance weight is
the log of the ratio of its probabilities, a sum over its n-grams. Its key is SHARP times the mean over its n-grams, so
that documents of all lengths meet one cut, plus Gumbel noise drawn from its id, of one scale for all documents: the k
largest keys are a sample without replacement with weights exp(SHARP x mean). k is given, or follows from the labels: as many documents as lie above the key that a share of the good documents reaches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, batches, column, hash_words, hashed_sample, materialise, shingle, splitmix, text_hash, utf8

_U = np.uint64
BITS = 16
BUCKETS = 2 << BITS
#: How sharply the sample follows the mean log ratio: noise has a spread of 1.28, so of 0.0064 in means.
SHARP = 200.0
#: Labelled rows that are used, at most.
LABELS = 50_000


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, and where each text's begin (texts + 1)."""
    data, offs = utf8(texts)
    _, _, h, first = hash_words(data, offs)
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    pairs = shingle(h, 2)
    inside = doc[1:] == doc[:-1]
    one, two = (h >> _U(64 - BITS)).astype(np.int64), (pairs[inside] >> _U(64 - BITS)).astype(np.int64) + (1 << BITS)
    both = np.r_[one, two]
    owner = np.r_[doc, doc[1:][inside]]
    order = np.argsort(owner, kind="stable")
    return both[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]


def labelled(labels: DataFrame, most: int = LABELS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and labels (1 good, 0 bad), sorted by id; beyond ``most``, those under a bound by a hash of the id."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("q"))
    got = hashed_sample(rows, most, "doc_id").toArrow()
    if got.num_rows == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, q = np.asarray(got["doc_id"].combine_chunks()), np.asarray(got["q"].combine_chunks())
    order = np.argsort(i)
    return i[order], q[order]


def _label_of(doc_ids: pa.Array, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """-1 where there is none."""
    ids, q = known
    x = np.asarray(doc_ids.cast(pa.int64()).fill_null(-(1 << 63)))
    if not len(ids):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    return np.where(ids[at] == x, q[at], -1)


def _holds_back(x: np.ndarray) -> np.ndarray:
    """A fifth of labelled documents, by a hash of the id, sets the cut and trains nothing."""
    return splitmix(x.astype(np.int64).view(_U)) % _U(5) == 0


def log_ratios(docs: DataFrame, known: tuple[np.ndarray, np.ndarray], smoothing: float = 1.0) -> np.ndarray:
    """Log of target over raw probability for each bucket; counts cover all documents."""

    def run(parts):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for whole in parts:
            for batch in batches(whole, most=2 << 20):
                b, starts = buckets(column(batch, "text"))
                raw += np.bincount(b, minlength=BUCKETS)
                ids = column(batch, "doc_id")
                x = np.asarray(ids.cast(pa.int64()).fill_null(-1))
                good = (_label_of(ids, known) == 1) & ~_holds_back(x)
                if good.any():
                    target += np.bincount(b[np.repeat(good, np.diff(starts))], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["at", "raw", "target"])

    sums = arrow(docs.select("doc_id", "text"), run, "at int, raw long, target long").groupBy("at").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    if sums.num_rows:
        at = np.asarray(sums["at"].combine_chunks())
        raw[at] = np.asarray(sums["raw"].combine_chunks())
        target[at] = np.asarray(sums["target"].combine_chunks())
    out = np.zeros(BUCKETS)
    for part in (slice(0, 1 << BITS), slice(1 << BITS, BUCKETS)):
        # both models are smoothed by as much of the raw model as makes a bucket's expected target count one larger
        share = target[part].sum() / max(raw[part].sum(), 1)
        out[part] = np.log((target[part] + smoothing) / (raw[part] * share + smoothing))
    return out


def _keys(batch: pa.RecordBatch, known, ratios: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weights, SHARP times their means over n-grams with Gumbel noise, and labels of the documents that set the cut (others -1)."""
    b, starts = buckets(column(batch, "text"))
    total = np.r_[0.0, np.cumsum(ratios[b])]
    w = total[starts[1:]] - total[starts[:-1]]
    data, offs = utf8(column(batch, "text"))
    x = np.asarray(column(batch, "doc_id").cast(pa.int64()).fill_null(-1))
    noise = splitmix(splitmix(x.view(_U) + _U(seed)) ^ text_hash(data, offs))
    gumbel = -np.log(-np.log(((noise >> _U(12)).astype(np.float64) + 0.5) / 2.0**52))
    return w, SHARP * w / np.maximum(np.diff(starts), 1) + gumbel, np.where(_holds_back(x), _label_of(column(batch, "doc_id"), known), -1)


class Resampler:
    """The two models' log ratios, and the labels that set the cut.

    Defined cases: without a label that says good all documents have weight 0; rows without a doc_id, and labels without
    one or without a quality, are no samples; of several labels of one doc_id the worst counts.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, most_labels: int = LABELS, seed: int = 29):
        known = labelled(labels, most_labels)
        ratios = log_ratios(docs, known) if (known[1] == 1).any() else np.zeros(BUCKETS)
        self.seed = seed
        self.shared = docs.sparkSession.sparkContext.broadcast((known, ratios))

    def weigh(self, docs: DataFrame) -> DataFrame:
        """Per row: doc_id, label (-1: none, or not one that sets the cut), log_weight, key (the mean, sharpened, with noise)."""
        shared, seed = self.shared, self.seed

        def run(parts):
            for whole in parts:
                for batch in batches(whole, most=2 << 20):
                    w, key, label = _keys(batch, *shared.value, seed)
                    yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(label.astype(np.int32)), pa.array(w), pa.array(key)], ["doc_id", "label", "log_weight", "key"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        return arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, label int, log_weight double, key double")

    def cut(self, weights: DataFrame, k: int | None = None, keep_good: float = 0.998) -> float:
        """The k-th largest key; without k, k is how many documents reach the key that ``keep_good`` of the good ones do."""
        if k is None:
            good = weights.where("label = 1")
            n = good.count()
            found = kth_largest(good, "key", int(np.ceil(keep_good * n))) if n else None
        else:
            found = kth_largest(weights, "key", k)
        return -float("inf") if found is None else found

    def filter(self, docs: DataFrame, cut: float) -> DataFrame:
        """Rows of ``docs``, all columns, whose key reaches the cut; nothing is shuffled."""
        shared, seed = self.shared, self.seed

        def run(parts):
            for whole in parts:
                for batch in batches(whole, most=2 << 20):
                    yield batch.filter(pa.array(_keys(batch, *shared.value, seed)[1] >= cut))

        return arrow(docs, run, docs.schema)


def kth_largest(rows: DataFrame, name: str, k: int, enough: int = 5000) -> float | None:
    """The k-th largest value of a column (null if there are fewer), by counting in ever narrower ranges; at most
    4,097 counts or ``enough`` values come to the driver at a time."""
    rows = rows.select(F.col(name).alias("x")).where("x is not null")
    total, lo, hi = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if k < 1 or total < k:
        return None
    while lo < hi:
        inside = rows.where(F.col("x").between(lo, hi))
        if total <= enough:
            return sorted((r.x for r in inside.collect()), reverse=True)[k - 1]
        width = (hi - lo) / 4096
        if width == 0:
            break
        for r in inside.groupBy(F.floor((F.col("x") - lo) / width).alias("g")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy(F.desc("g")).collect():
            if r.n >= k:
                total, lo, hi = r.n, r.lo, r.hi
                break
            k -= r.n
    return hi


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, keep_good: float = 0.998, most_labels: int = LABELS) -> DataFrame:
    """Per row: doc_id, log_weight, key, kept.

    Defined cases: a null or empty text has weight 0 and its noise alone; a null doc_id is weighed like any other but
    has no label; rows with equal doc_id and text get equal keys; without good labels all documents weigh alike and,
    where no k is given, all are kept; an empty table gives an empty one; further columns are ignored.
    """
    model = Resampler(docs, labels, most_labels)
    weights = materialise(model.weigh(docs))
    return weights.select("doc_id", "log_weight", "key", (F.col("key") >= F.lit(model.cut(weights, k, keep_good))).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, k: int | None = None, keep_good: float = 0.998, most_labels: int = LABELS) -> DataFrame:
    """``docs`` without the documents that ``classify`` rejects; k is how many stay, by Gumbel top-k, or follows from the labels.

    Defined cases: as in ``classify``; of equal keys at the cut all stay, so rows with equal doc_id and text stay or go
    together; further columns are kept.
    """
    model = Resampler(docs, labels, most_labels)
    return model.filter(docs, model.cut(materialise(model.weigh(docs)), k, keep_good))
