"""Toxicity by non-negative positive-unlabelled learning.

A logistic model on hashed words and beginnings of words is trained from documents that are confirmed toxic and from
all others without their labels. With the share of toxic documents (the class prior) known, the risk of the others as
clean ones is that of all documents less the prior's share of the toxic ones; where sampling noise makes it negative the
model has begun to learn single documents, and a step goes back up that part instead.

Buckets are counted over all documents, and the FEATURES that tell most become the model's. Which of them a document has
is written once; each step is a pass over that small table which sends a gradient from each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, batches, column, hash_words, hashed_sample, materialise, splitmix, utf8

_U = np.uint64
BITS = 18
#: Bytes of a word's beginnings that are features of their own.
STARTS = (3, 4, 5, 6)
#: How often a document must have one for further features.
TIMES = (2, 3, 5)
#: Buckets that become features, confirmed toxic documents that train, and steps, at most.
FEATURES, POSITIVES, STEPS = 2048, 50_000, 60
#: Step size, and the share of toxic documents, by the prior, among those with a bucket that becomes a feature.
RATE, TELLS = 0.3, 0.25
_APART = np.ones(256, bool)
_APART[128:] = False
_APART[[*range(65, 91), *range(97, 123)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _often(at: np.ndarray, times: int) -> np.ndarray:
    """The bucket that says a bucket comes ``times`` times."""
    return (splitmix(at.astype(_U) + _U(times << 32)) >> _U(64 - BITS)).astype(np.int64)


def buckets(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each distinct feature of each text, in order: words, their beginnings, and either of them
    that comes several times. Words are runs of letters and of bytes that are not ASCII, in lower case (A-Z only).
    ``wanted`` leaves out other words and beginnings, by their buckets, before they are counted."""
    data, offs = utf8(texts)
    s, e, h, first = hash_words(data, offs, lower=True, space=_APART)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(_U) << _U(BITS)
    bytes_ = np.lib.stride_tricks.sliding_window_view(np.r_[_LOWER[data], np.zeros(8, np.uint8)], 8)[s].view("<u8").ravel()
    keys = []

    def add(hashes, docs):
        at = hashes >> _U(64 - BITS)
        if wanted is not None:
            there = wanted[at]
            at, docs = at[there], docs[there]
        keys.append(docs | at)

    add(h, doc)
    for n in STARTS:
        long = e - s >= n
        add(splitmix((bytes_[long] & _U((1 << 8 * n) - 1)) * _U(0xA24BAED4963EE407) + _U(n)), doc[long])
    keys, n = np.unique(np.concatenate(keys), return_counts=True)
    doc, at = (keys >> _U(BITS)).astype(np.int64), (keys & _U((1 << BITS) - 1)).astype(np.int64)
    often = [n >= times for times in TIMES]
    docs = np.concatenate([doc, *(doc[o] for o in often)])
    ats = np.concatenate([at, *(_often(at[o], times) for o, times in zip(often, TIMES))])
    order = np.argsort(docs << BITS | ats)
    docs, ats = docs[order], ats[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (ats[1:] != ats[:-1])
    return docs[new], ats[new]


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text leaves no remainder by 5; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, most: int = POSITIVES) -> tuple[np.ndarray, float]:
    """Ids of confirmed toxic documents, sorted, and the share of toxic ones among the labelled; none is held out."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n, toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    got = hashed_sample(rows.where("toxic = 1"), most, "doc_id").toArrow()
    return np.sort(np.asarray(got["doc_id"].combine_chunks())) if got.num_rows else np.zeros(0, np.int64), (toxic or 0) / max(n, 1)


def _positive(doc_ids: pa.Array, known: np.ndarray) -> np.ndarray:
    x = np.asarray(doc_ids.cast(pa.int64()).fill_null(-(1 << 63)))
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def chosen_features(docs: DataFrame, known: np.ndarray, prior: float, most: int = FEATURES) -> np.ndarray:
    """Buckets whose documents are toxic more often than chance makes them, and for a share of TELLS at least: the surest
    ones. What tells less, such as a language, would carry the sampling noise of the toxic documents to clean ones."""

    def run(parts):
        counts = np.zeros((2, 1 << BITS), np.int64)
        sizes = np.zeros(2, np.int64)
        for whole in parts:
            for batch in batches(whole, most=1 << 20):
                doc, at = buckets(column(batch, "text"))
                toxic = _positive(column(batch, "doc_id"), known)
                counts[0] += np.bincount(at, minlength=1 << BITS)
                counts[1] += np.bincount(at[toxic[doc]], minlength=1 << BITS)
                sizes += (len(toxic), int(toxic.sum()))
        some = np.flatnonzero(counts[0])
        at = np.r_[-1, some].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.r_[sizes[0], counts[0][some]]), pa.array(np.r_[sizes[1], counts[1][some]])], ["at", "n", "toxic"])

    got = arrow(docs.select("doc_id", "text"), run, "at int, n long, toxic long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    if got.num_rows == 0:
        return np.zeros(0, np.int64)
    at, n, toxic = (np.asarray(got[c].combine_chunks()).astype(np.int64) for c in ("at", "n", "toxic"))
    whole = at < 0
    share = n[~whole] / max(n[whole].sum(), 1)
    hits, of = toxic[~whole], toxic[whole].sum()
    sure = _ratio(hits, of * share) + _ratio(of - hits, of * (1 - share))
    sure = np.where(prior * hits >= TELLS * of * share, sure, 0)
    order = np.lexsort((at[~whole], -sure))[:most]
    # what chance reaches in none of so many buckets
    return np.sort(at[~whole][order][sure[order] > 2 * np.log(1 << BITS)])


def _ratio(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """A term of the log-likelihood ratio of counts seen and expected, twice."""
    return 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))


class Model:
    """The chosen buckets, sorted."""

    def __init__(self, features: np.ndarray):
        self.features = features
        every = np.arange(1 << BITS)
        #: Buckets that are features, or say something of one that comes several times.
        self.wanted = np.isin(every, features)
        for times in TIMES:
            self.wanted |= np.isin(_often(every, times), features)

    def places(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Document and feature number of each feature that a document has."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc, at = buckets(column(batch, "text"), self.wanted)
        where = np.minimum(np.searchsorted(self.features, at), len(self.features) - 1)
        there = self.features[where] == at
        return doc[there], where[there]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _gradients(table: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Sums over toxic and over all documents (two rows each): count, loss as a clean one, and gradients of the losses
    as a clean one and (toxic only) as a toxic one, intercept last."""
    size = len(weights)

    def run(parts):
        total = np.zeros((3, size + 2))
        for batch in parts:
            lists = column(batch, "features")
            flat, lengths = np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))
            doc = np.repeat(np.arange(len(lengths)), lengths)
            z = _logits(lists, weights)
            p, loss = _sigmoid(z), np.logaddexp(0, z)
            toxic = np.asarray(column(batch, "toxic").to_numpy(zero_copy_only=False), bool)
            for row, g, of in ((0, p, np.ones(len(z))), (1, p, toxic), (2, p - 1, toxic)):
                total[row, : size - 1] += np.bincount(flat, (g * of)[doc], minlength=size - 1)
                total[row, size - 1 :] += (g * of).sum(), of.sum(), (loss * of).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "v"])

    got = arrow(table, run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(3 * (size + 2))
    if got.num_rows:
        out[np.asarray(got["at"].combine_chunks())] = np.asarray(got["v"].combine_chunks())
    return out.reshape(3, size + 2)


def step(sums: np.ndarray, prior: float) -> np.ndarray:
    """The direction's gradient from the sums of ``_gradients``: of the whole risk, or, where the risk of clean documents
    is negative, up that risk alone."""
    size = sums.shape[1] - 2
    mean = lambda row: sums[row] / max(sums[row, size], 1)
    everything, as_clean, as_toxic = mean(0), mean(1), mean(2)
    clean = everything[size + 1] - prior * as_clean[size + 1]
    of_clean = everything[:size] - prior * as_clean[:size]
    return prior * as_toxic[:size] + of_clean if clean >= 0 else -of_clean


def with_features(docs: DataFrame, model: Model, known: np.ndarray) -> DataFrame:
    """Per document: doc_id, features (their numbers), toxic (confirmed)."""
    shared = docs.sparkSession.sparkContext.broadcast((model, known))

    def run(parts):
        model, known = shared.value
        for whole in parts:
            for batch in batches(whole, most=1 << 20):
                doc, where = model.places(batch)
                offs = np.r_[0, np.cumsum(np.bincount(doc, minlength=batch.num_rows))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(where.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), lists, pa.array(_positive(column(batch, "doc_id"), known))], ["doc_id", "features", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, features array<int>, toxic boolean")


def _logits(lists: pa.Array, weights: np.ndarray) -> np.ndarray:
    flat, lengths = np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))
    return np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights[flat], minlength=len(lengths)) + weights[-1]


def train(table: DataFrame, size: int, prior: float, positives: int, steps: int = STEPS) -> np.ndarray:
    """Weights of ``size`` features and an intercept from the documents of ``with_features`` that are not held out."""
    table = table.where(~held_out()).select("features", "toxic")
    w = np.zeros(size + 1)
    w[-1] = _odds(prior)
    # a standard normal prior of the weights, over as many documents as the toxic ones stand for
    penalty = prior / max(positives, 1)
    mean, square = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        g = step(_gradients(table, w), prior)
        g[:-1] += penalty * w[:-1]
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w = w - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return w


def _odds(prior: float) -> float:
    return float(np.log(prior / (1 - prior))) if 0 < prior < 1 else -35.0 if prior <= 0 else 35.0


def score(docs: DataFrame, labels: DataFrame, most: int = FEATURES, steps: int = STEPS, most_labels: int = POSITIVES) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, the model's probability of toxic), predicted (1 from 0.5 on).

    Labels are read of documents that are not held out: toxic ones (at most ``most_labels``, chosen by a hash of the id)
    and how many of the labelled are toxic. Everything else covers all documents that are not held out. Texts are read
    twice: to count buckets, and to write which features each document has, from which steps and scores are taken.

    Defined cases: a null or empty text has the score of a text without features; a null doc_id has no label and is not
    held out; rows with equal doc_id share its label, and of several labels of one doc_id the toxic one counts; without
    a toxic label all documents have the same score, near 0; an empty table gives an empty one; further columns are ignored.
    """
    known, prior = training_labels(labels, most_labels)
    features = chosen_features(docs.where(~held_out()), known, prior, most) if len(known) else np.zeros(0, np.int64)
    table = materialise(with_features(docs, Model(features), known))
    weights = train(table, len(features), prior, len(known), steps) if len(features) else np.array([_odds(prior)])

    def run(parts):
        for batch in parts:
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(_sigmoid(_logits(column(batch, "features"), weights)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = arrow(table.select("doc_id", "features"), run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
