"""Language-model scoring: a log-bilinear neural model trained with noise-contrastive estimation.

The model's vocabulary is the most frequent training tokens and classes of all others, by their last two bytes. A
position's prediction is the sum of its two context tokens' vectors, each scaled by that position's diagonal; a token's score is
the prediction times the token's vector plus a bias, and probabilities are normalised over the whole vocabulary: the
normalisers of all contexts come from batched matrix products, once, and a token's score is then three look-ups.
A token of a class has the class's probability times its add-one unigram probability inside the class, by counts over
all training tokens, with one more share for what was never seen, so the model gives a probability to every text.

Training: each task runs stochastic gradient steps over its share of all training documents, from common parameters;
the parameters are averaged by tokens between rounds. Token counts are exact and cover all training documents. Counts
of the most frequent tokens (a fixed number) go to the tasks; rarer tokens meet their counts in a join.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, batches, column, hash_words, materialise, signed, splitmix, text_hash, utf8

_U = np.uint64
#: Hashes of the end token and of what precedes a text; no word has them but by chance, 1 in 2^64.
END, BEFORE = np.array([0x51ED270B, 0x2545F491], _U) * _U(0x9E3779B97F4A7C15)
VOCAB, CLASSES, DIM, NOISE, BATCH = 768, 512, 16, 6, 16384
#: Frequent tokens whose counts every task knows.
KNOWN = 100_000


def held_out_ids(doc_ids: list) -> np.ndarray:
    """crc32 of the id as text, mod 7, is 2; a null id counts as the empty text."""
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in doc_ids], bool)


_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text followed by END, the places where texts start (texts + 1), and what
    tokens' classes come from: their last two bytes, lower-case."""
    data, offs = utf8(texts)
    begin, end, h, first = hash_words(data, offs, lower=True)
    n = len(first) - 1
    place = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))
    out, tail = np.full(len(h) + n, END, _U), np.zeros(len(h) + n, np.int32)
    out[place] = h
    if len(h):
        tail[place] = _LOWER[data[end - 1]] + np.where(end - begin > 1, _LOWER[data[np.maximum(end - 2, 0)]], 0) * 256
    return out, first + np.arange(n + 1), tail


def class_of(tail: np.ndarray, classes: int) -> np.ndarray:
    return (splitmix(tail.astype(_U) + _U(0x2F0B4C47)) % _U(classes)).astype(np.int64)


def _chunks(parts, keep=None, most: int = 8 << 20):
    """(batch, tokens, starts, tails), of training documents only where ``keep`` says so."""
    for whole in parts:
        for batch in batches(whole, most=most):
            if keep is not None:
                batch = batch.filter(pa.array(keep(column(batch, "doc_id").to_pylist())))
                if batch.num_rows == 0:
                    continue
            yield (batch, *_tokens(column(batch, "text")))


def token_counts(docs: DataFrame) -> DataFrame:
    """token (hash), c, its count, and tail (see ``_tokens``), over all training documents."""

    def run(parts):
        seen: list = []
        size = 0

        def flush():
            h, c, t = (np.concatenate(x) for x in zip(*seen))
            u, at, inv = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(inv, c).astype(np.int64)
            seen.clear()
            return u, total, t[at]

        def out(u, c, t):
            for at in range(0, len(u), 50_000):
                to = at + 50_000
                yield pa.RecordBatch.from_arrays([pa.array(signed(u[at:to])), pa.array(c[at:to]), pa.array(t[at:to])], ["token", "c", "tail"])

        for _, h, _, tail in _chunks(parts, lambda i: ~held_out_ids(i)):
            u, at, c = np.unique(h, return_index=True, return_counts=True)
            seen.append((u, c, tail[at]))
            size += len(u)
            if size > 1_500_000:
                found = flush()
                if len(found[0]) > 750_000:
                    yield from out(*found)
                    size = 0
                else:
                    seen.append(found)
                    size = len(found[0])
        if seen:
            yield from out(*flush())

    return arrow(docs.select("doc_id", "text"), run, "token long, c long, tail int").groupBy("token").agg(F.sum("c").alias("c"), F.min("tail").alias("tail"))


class LogBilinear:
    """Parameters: r (context vectors), d (two diagonals), q (token vectors), b (biases)."""

    def __init__(self, unigram: np.ndarray, dim: int = DIM, seed: int = 11):
        v = len(unigram)
        rng = np.random.default_rng(seed)
        self.p = (unigram + 0.5) / (unigram + 0.5).sum()
        self.r = rng.normal(0, 0.1, (v + 1, dim)).astype(np.float32)  # the last row stands before a text
        self.q = rng.normal(0, 0.1, (v, dim)).astype(np.float32)
        self.d = np.ones((2, dim), np.float32)
        self.lp = np.log(self.p).astype(np.float32)
        self.b = self.lp.copy()

    def vector(self) -> np.ndarray:
        return np.concatenate([self.r.ravel(), self.q.ravel(), self.d.ravel(), self.b])

    def load(self, x: np.ndarray) -> LogBilinear:
        at = 0
        for name in ("r", "q", "d", "b"):
            old = getattr(self, name)
            setattr(self, name, np.asarray(x[at : at + old.size], np.float32).reshape(old.shape).copy())
            at += old.size
        return self

    def train(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray, rate: float, rng, noise: int = NOISE) -> None:
        """One gradient step of noise-contrastive estimation.

        The batch is in random order, so its own tokens, shifted by random distances, are noise drawn from the unigram
        distribution. A parameter moves by the mean gradient over its uses, softened so that rare tokens move carefully.
        """
        n, (v, dim) = len(w), self.q.shape
        if n < 2:
            return
        r1, r2, qw = self.r.T[:, w1], self.r.T[:, w2], self.q.T[:, w]
        d1, d2 = self.d[0][:, None], self.d[1][:, None]
        pred = r1 * d1 + r2 * d2
        offset = (self.b - self.lp - np.float32(np.log(noise)))[w]
        g = 1 / (1 + np.exp(np.clip((pred * qw).sum(axis=0) + offset, -40, 40)))  # slope of the log sigmoid at the data
        gp, gq, gb = g * qw, g * pred, g.copy()
        for shift in rng.integers(1, n, noise):
            qn = np.roll(qw, shift, axis=1)
            g = -1 / (1 + np.exp(np.clip(-(pred * qn).sum(axis=0) - np.roll(offset, shift), -40, 40)))  # and at the noise
            gp += g * qn
            gq += np.roll(g * pred, -shift, axis=1)
            gb += np.roll(g, -shift)
        add = lambda rows, values, size: np.stack([np.bincount(rows, x, size) for x in values], axis=1)
        used = np.bincount(w, minlength=v) + 20.0
        seen = np.bincount(w1, minlength=v + 1) + np.bincount(w2, minlength=v + 1) + 20.0
        gr = add(w1, gp * d1, v + 1) + add(w2, gp * d2, v + 1)
        gd = np.stack([(gp * r1).mean(axis=1), (gp * r2).mean(axis=1)])
        step = lambda x: np.clip(rate * x, -0.5, 0.5).astype(np.float32)
        self.q += step(add(w, gq, v) / used[:, None])
        self.b += step(np.bincount(w, gb, v) / used)
        self.r += step(gr / seen[:, None])
        self.d += step(gd)

    def scorer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (previous token, token), by (the one before, token), and log10 normalisers of all contexts."""
        a1 = (self.r * self.d[0]) @ self.q.T + self.b
        a2 = (self.r * self.d[1]) @ self.q.T
        e1, e2 = np.exp(a1 - a1.max(axis=1, keepdims=True)), np.exp(a2 - a2.max(axis=1, keepdims=True))
        # log of sum_w exp(a1[i, w] + a2[j, w]) for all contexts (i, j) is one matrix product
        z = np.log(np.maximum(e1.astype(np.float64) @ e2.astype(np.float64).T, 1e-300)) + a1.max(axis=1)[:, None] + a2.max(axis=1)[None, :]
        return (a1 / np.log(10)).astype(np.float32), (a2 / np.log(10)).astype(np.float32), (z / np.log(10)).astype(np.float32)


def _contexts(h: np.ndarray, starts: np.ndarray, tail: np.ndarray, words: tuple[np.ndarray, np.ndarray], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary places of each token and of the two before it; ``words`` are the vocabulary's sorted hashes and their
    places, which classes follow."""
    keys, places = words
    v = len(keys) + classes
    w = len(keys) + class_of(tail, classes)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        w = np.where(keys[at] == h, places[at], w)
    w1 = np.r_[v, w[:-1]][: len(w)]
    w2 = np.r_[v, v, w[:-2]][: len(w)]
    w1[starts[:-1]] = v
    w2[starts[:-1]] = v
    second = starts[:-1] + 1
    w2[second[second < starts[1:]]] = v
    return w, w1, w2


def fit(docs: DataFrame, words: tuple[np.ndarray, np.ndarray], unigram: np.ndarray, rounds: int = 1, rate: float = 0.6, dim: int = DIM) -> LogBilinear:
    """Train on all training documents; parameters are averaged by tokens over tasks after each round."""
    model = LogBilinear(unigram, dim)
    classes = len(unigram) - len(words[0])
    for turn in range(rounds):
        start = model.vector()

        def run(parts, start=start, turn=turn):
            own = LogBilinear(unigram, dim).load(start)
            rng = np.random.default_rng(turn)
            tokens = 0
            for _, h, starts, tail in _chunks(parts, lambda i: ~held_out_ids(i), most=2 << 20):
                w, w1, w2 = _contexts(h, starts, tail, words, classes)
                order = rng.permutation(len(w))
                step = min(BATCH, max(512, len(w) // 24))  # small shares also get some steps
                for at in range(0, len(w), step):
                    take = order[at : at + step]
                    own.train(w2[take], w1[take], w[take], rate / (1 + tokens / 2e6) ** 0.5 / (1 + turn), rng)
                    tokens += len(take)
            if tokens:
                x = own.vector().astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x * tokens), pa.array(np.full(len(x), float(tokens)))], ["at", "x", "n"])

        got = arrow(docs.select("doc_id", "text"), run, "at int, x double, n double").groupBy("at").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()
        if got.num_rows:
            x = start.astype(np.float64)
            x[np.asarray(got["at"].combine_chunks())] = np.asarray(got["x"].combine_chunks())
            model.load(x)
    return model


def score(docs: DataFrame, vocab: int = VOCAB, rounds: int = 1, known: int = KNOWN, classes: int = CLASSES, dim: int = DIM) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    The model has ``vocab`` words and ``classes`` of the others. Tasks train on their own shares of the documents, so
    scores differ a little between ways of dealing documents to tasks.

    Defined cases: a null or empty text is the end token alone; a null doc_id counts as the empty text for the split;
    rows with equal doc_id and text get equal values, each its own row; without any training document every count is 0
    and the model is uniform; an empty table gives an empty one; further columns are ignored.
    """
    spark = docs.sparkSession
    counts = materialise(token_counts(docs))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    # the frequent tokens: all above a count, on a scale of 32 steps to the octave, that at most ``known`` tokens pass,
    # and of the next step, whose tokens count as ties, those whose hash lies under a bound
    step = F.floor(F.log2(F.col("c").cast("double")) * 32)
    passed, cut, share = 0, 1 << 20, 0.0
    for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect():
        if passed + r.n > known:
            share = max(0.0, (known - passed) - 5 * (known - passed) ** 0.5) / r.n if known > 1000 else (known - passed) / r.n
            break
        passed, cut = passed + r.n, r.s
    tie = F.pmod(F.xxhash64("token"), F.lit(1 << 40)) < int(share * (1 << 40))
    top = counts.where((step >= cut) | ((step == (counts.where(step < cut).agg(F.max(step)).first()[0] if share else None)) & tie)).toArrow()
    top_h = np.asarray(top["token"].combine_chunks()).view(_U) if top.num_rows else np.zeros(0, _U)
    top_c = np.asarray(top["c"].combine_chunks()) if top.num_rows else np.zeros(0, np.int64)
    top_k = class_of(np.asarray(top["tail"].combine_chunks()), classes) if top.num_rows else np.zeros(0, np.int64)
    by_count = np.lexsort((top_h, -top_c))
    top_h, top_c, top_k = top_h[by_count], top_c[by_count], top_k[by_count]
    order = np.argsort(top_h)
    keys, key_counts = top_h[order], top_c[order]
    head = min(vocab - 1, len(top_h))
    rank = np.argsort(top_h[:head])
    words = (top_h[:head][rank], rank.astype(np.int64))
    # tokens and distinct tokens of each class, without the words
    by_tail = counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow()
    of = class_of(np.asarray(by_tail["tail"].combine_chunks()), classes) if by_tail.num_rows else np.zeros(0, np.int64)
    n_rest, v_rest = (np.bincount(of, np.asarray(by_tail[x].combine_chunks()) if by_tail.num_rows else None, classes) for x in ("c", "v"))
    n_rest = n_rest - np.bincount(top_k[:head], top_c[:head], classes)
    v_rest = v_rest - np.bincount(top_k[:head], minlength=classes)
    unigram = np.r_[top_c[:head], n_rest].astype(np.float64)
    model = fit(docs, words, unigram, rounds, dim=dim)
    shared = spark.sparkContext.broadcast((words, keys, key_counts, np.log10(n_rest + v_rest + 1.0), *model.scorer()))
    base_log = float(np.log10(n + v + 1))

    def run(parts):
        words, keys, key_counts, rest_log, a1, a2, z = shared.value
        for batch, h, starts, tail in _chunks(parts, most=2 << 20):
            rows = len(starts) - 1
            w, w1, w2 = _contexts(h, starts, tail, words, classes)
            doc = np.repeat(np.arange(rows), np.diff(starts))
            lm = a1[w1, w].astype(np.float64) + a2[w2, w] - z[w1, w2]
            rest = w >= len(words[0])
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            found = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            c = np.where(found, key_counts[at] if len(keys) else 0, 0)
            here = np.where(found, np.log10(c + 1.0), 0.0)
            sums = lambda x: np.bincount(doc, x, rows)
            n_tokens = np.diff(starts)
            base = sums(here) - n_tokens * base_log
            model_part = sums(lm) + sums(np.where(rest, here - rest_log[np.where(rest, w - len(words[0]), 0)], 0.0))
            data, offs = utf8(column(batch, "text"))
            key = splitmix(text_hash(data, offs) ^ splitmix(np.array([0 if i is None else int(i) & (2**64 - 1) for i in column(batch, "doc_id").to_pylist()], _U)))
            far = ~found
            pair = splitmix(h[far]) ^ key[doc[far]]
            u, first, times = np.unique(pair, return_index=True, return_counts=True)
            del u
            far_h, far_doc = h[far][first], doc[far][first]
            m = len(far_h)
            none = np.zeros(m, np.int64)
            ids = column(batch, "doc_id").take(pa.array(np.r_[np.arange(rows), far_doc]))
            held = held_out_ids(column(batch, "doc_id").to_pylist())
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(signed(np.r_[key, key[far_doc]])), pa.array(signed(np.r_[splitmix(key), far_h])),
                pa.array(np.r_[np.ones(rows, np.int64), none]), pa.array(np.r_[n_tokens, none]), pa.array(np.r_[sums(found).astype(np.int64), none]),
                pa.array(np.r_[base, none.astype(float)]), pa.array(np.r_[model_part, none.astype(float)]), pa.array(np.r_[np.zeros(rows, np.int64), times]), pa.array(np.r_[held, np.zeros(m, bool)]),
            ], ["doc_id", "row", "token", "rows", "n_tokens", "n_known", "base_score", "score", "times", "held_out"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, row long, token long, rows long, n_tokens long, n_known long, base_score double, score double, times long, held_out boolean")
    # a document's own row carries a token that occurs nowhere, so one outer join serves both kinds
    rows = rows.join(counts, "token", "left")
    gain = F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0)).otherwise(0.0)
    # rows with equal doc_id and text share a key: their sums hold each of them once
    g = rows.groupBy("row", "doc_id").agg(
        F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base_score")).alias("base"), F.sum(F.col("score")).alias("lm"), F.sum(gain).alias("gain"), F.max("held_out").alias("held_out"))
    g = g.select("doc_id", "held_out", F.expr("n_tokens div rows").alias("n_tokens"), F.expr("n_known div rows").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                 ((F.col("base") + F.col("gain")) / F.col("rows")).alias("base_score"), ((F.col("lm") + F.col("gain")) / F.col("rows")).alias("score"), "rows")
    once = g.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return once.drop("rows", "__i")
