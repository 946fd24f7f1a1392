"""Phrase collocation mining by pivot partitioning.

Words are counted first. An n-gram belongs to its rarest word, its pivot: every occurrence of a frequent word sends what
the n-grams that it owns can see of its piece (up to four words to each side, as far as words are commoner than the
pivot; ties by number, equal words count to the left one only) to the pivot's partition. There n-grams are mined level
by level: one is counted only if its two parts that hold the pivot are frequent. A pivot that occurs more often than a
partition should hold is spread over several, whose counts are partial and summed afterwards; its n-grams hold common
words only, so they are few.

Words are told apart by 62-bit hashes, which are mixed with the language. The VOCABULARY most common words are known to
every task by rank and counted as commoner than all others; others that occur often enough pass a bit set of fixed size,
so that a rare word may pass as a frequent one and cost time, never results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Bloom, arrow, batches, column, grouped, hash_words, join_hot, materialise, shuffle_partitions, splitmix, text_hash, utf8
from .resampling import kth_largest

_U = np.uint64
#: Words whose ranks every task knows: 16 MB.
VOCABULARY = 1 << 20
#: Words of a partition, about, at most.
SIZE = 500_000
#: Rows that one task ranks by language before they meet in one.
TOP_ROWS = 100_000
LONGEST = 5
_SIDE = LONGEST - 1
_BEYOND = 1 << 62
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_APART = _BREAK.copy()
_APART[[32, 9]] = True
UNKNOWN = "und"


def _words(batch: pa.RecordBatch):
    """Of all words of a batch: bytes, starts, ends, codes (62 bits, by language) and whether a piece begins; and each
    document's language hash and first word."""
    data, offs = utf8(column(batch, "text"))
    s, e, h, first = hash_words(data, offs, lower=True, space=_APART)
    # mixed once more than words are: a word and a language of one name have one hash, and two of them would swap
    lang = splitmix(text_hash(*utf8(column(batch, "lang").fill_null(UNKNOWN))) + _U(1))
    codes = splitmix(h ^ np.repeat(lang, np.diff(first))) >> _U(2)
    at = np.searchsorted(np.flatnonzero(_BREAK[data]), s)
    begins = np.ones(len(s), bool)
    begins[1:] = at[1:] != at[:-1]
    begins[first[:-1][np.diff(first) > 0]] = True
    return data, s, e, codes.astype(np.int64), begins, lang, first


def _strings(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """Words in lower case (A-Z only) as an Arrow column."""
    offs = np.r_[0, np.cumsum(e - s)]
    out = data[np.repeat(s - offs[:-1], e - s) + np.arange(offs[-1])]
    out = np.where((out >= 65) & (out <= 90), out + 32, out).astype(np.uint8)
    return pa.StringArray.from_buffers(len(s), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(out))


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, code, word, n of the words that occur ``least`` times or more, and a row for each language with a null word
    and the number of all its words."""

    def run(parts):
        for whole in parts:
            for batch in batches(whole, most=2 << 20):
                data, s, e, codes, _, lang, first = _words(batch)
                langs = column(batch, "lang").fill_null(UNKNOWN)
                _, some, of = np.unique(lang, return_index=True, return_inverse=True)
                total = np.bincount(of, np.diff(first), minlength=len(some)).astype(np.int64)
                names = langs.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.zeros(len(some), np.int64)), pa.nulls(len(some), pa.string()), pa.array(total)], ["lang", "code", "word", "n"])
                own, at, n = np.unique(codes, return_index=True, return_counts=True)
                owner = of[np.searchsorted(first, at, "right") - 1]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(owner)), pa.array(own), _strings(data, s[at], e[at]), pa.array(n)], ["lang", "code", "word", "n"])

    counts = arrow(docs.select("lang", "text"), run, "lang string, code long, word string, n long")
    return counts.groupBy("lang", "code", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("word").isNull())


class Ranks:
    """Numbers of words: 1, 2, ... from the commonest on, for at most VOCABULARY of them; others have their code plus 2^62,
    and 0 if they are certainly not frequent. So of two words the one with the larger number is the rarer."""

    def __init__(self, words: DataFrame, total: int, partitions: int):
        kth = kth_largest(words, "n", VOCABULARY)
        got = (words if kth is None else words.where(F.col("n") > kth)).select("code", "n").toArrow()
        codes, n = (np.asarray(got[c].combine_chunks()) for c in ("code", "n"))
        order = np.lexsort((codes, -n))
        self.codes, self.counts = codes[order], n[order]
        self.share = max(1, total // partitions)
        self.partitions = partitions
        self._by_code = np.argsort(self.codes)
        #: Which of an array of codes may be frequent words without a rank; it goes to tasks by itself.
        self.others = None if kth is None else Bloom(words, "code", hashed=True).test()

    def __getstate__(self):
        return {**self.__dict__, "others": None}

    def number(self, codes: np.ndarray, others=None) -> np.ndarray:
        out = np.zeros(len(codes), np.int64)
        if others is not None:
            out = np.where(others(codes), codes + _BEYOND, 0)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, codes, sorter=self._by_code), len(self.codes) - 1)
            rank = self._by_code[at]
            out = np.where(self.codes[rank] == codes, rank + 1, out)
        return out

    def code(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return numbers - _BEYOND
        return np.where(numbers >= _BEYOND, numbers - _BEYOND, self.codes[np.minimum(numbers - 1, len(self.codes) - 1)])

    def deal(self, pivots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Partition of each fragment: by pivot, or, from ``partitions`` on, by pivot and key where the pivot is hot."""
        n = np.where(pivots <= len(self.counts), self.counts[np.minimum(pivots, len(self.counts)) - 1], 0) if len(self.counts) else np.zeros(len(pivots), np.int64)
        salts = -(-n // self.share)
        mixed = splitmix(pivots.astype(_U))
        hot = salts > 1
        mixed = np.where(hot, splitmix(mixed + keys % np.maximum(salts, 1).astype(_U)), mixed)
        return (mixed % _U(self.partitions)).astype(np.int64) + hot * self.partitions


def _fold(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    out = np.zeros(len(rows), _U)
    for j in range(rows.shape[1]):
        out = splitmix(out * _U(0xA24BAED4963EE407) + rows[:, j].astype(_U) + _U(1))
    return out


def fragments(numbers: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each word that owns an n-gram: 9 numbers, itself in the middle, 0 where its n-grams do not reach."""
    places = np.arange(len(numbers)) + np.cumsum(begins) + _SIDE - 1
    line = np.zeros((places[-1] if len(places) else 0) + 1 + _SIDE, np.int64)
    line[places] = numbers
    if len(line) <= 2 * _SIDE:
        return np.zeros((0, 2 * _SIDE + 1), np.int64)
    out = np.lib.stride_tricks.sliding_window_view(line, 2 * _SIDE + 1)
    some = (out[:, _SIDE] > 0) & (((out[:, _SIDE - 1] > 0) & (out[:, _SIDE - 1] < out[:, _SIDE])) | ((out[:, _SIDE + 1] > 0) & (out[:, _SIDE + 1] <= out[:, _SIDE])))
    out = out[some].copy()
    pivot = out[:, _SIDE]
    left, right = np.ones(len(out), bool), np.ones(len(out), bool)
    for j in range(1, _SIDE + 1):
        left &= (out[:, _SIDE - j] > 0) & (out[:, _SIDE - j] < pivot)
        right &= (out[:, _SIDE + j] > 0) & (out[:, _SIDE + j] <= pivot)
        out[~left, _SIDE - j] = 0
        out[~right, _SIDE + j] = 0
    return out


def _together(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, their hashes, and sums of n."""
    keys, first, of = np.unique(_fold(rows), return_index=True, return_inverse=True)
    return rows[first], keys, np.bincount(of, n, minlength=len(first)).astype(np.int64)


def _pack(rows: np.ndarray, n: np.ndarray) -> bytes:
    """Fragments as compressed bytes: counts of words to the left and right, n, and words without their zeros."""
    there = rows > 0
    sides = (there[:, :_SIDE].sum(axis=1) * LONGEST + there[:, _SIDE + 1 :].sum(axis=1)).astype(np.uint8)
    longs = np.r_[n, rows[there]]
    # bytes of equal weight lie together: high ones of small numbers are zeros
    raw = sides.tobytes() + longs.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(rows).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    m, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], size, "zstd", asbytes=True), np.uint8)
    left, right = (x[:, None] for x in divmod(raw[:m].astype(np.int64), LONGEST))
    longs = np.ascontiguousarray(raw[m:].reshape(8, -1).T).view(np.int64).ravel()
    rows = np.zeros((m, 2 * _SIDE + 1), np.int64)
    at = np.arange(-_SIDE, _SIDE + 1)
    rows[(at >= -left) & (at <= right)] = longs[m:]
    return rows, longs[:m]


def mine(rows: np.ndarray, n: np.ndarray, least: int):
    """(n-grams, counts) for each length and place of the pivot: those that reach ``least``, level by level."""
    there = rows > 0
    left, right = there[:, :_SIDE].sum(axis=1), there[:, _SIDE + 1 :].sum(axis=1)
    alive: dict[tuple[int, int], np.ndarray] = {(0, 0): np.ones(len(rows), bool)}
    for size in range(2, LONGEST + 1):
        for b in range(size):
            e = size - 1 - b
            some = (left >= b) & (right >= e)
            for part in ((b - 1, e), (b, e - 1)):
                if min(part) >= 0:
                    some &= alive[part]
            at = np.flatnonzero(some)
            grams = rows[at, _SIDE - b : _SIDE + e + 1]
            _, first, of = np.unique(_fold(grams), return_index=True, return_inverse=True)
            total = np.bincount(of, n[at], minlength=len(first)).astype(np.int64)
            good = total >= least
            alive[b, e] = np.zeros(len(rows), bool)
            alive[b, e][at] = good[of]
            if good.any():
                yield grams[first[good]], total[good]


def gram_counts(docs: DataFrame, ranks: Ranks, least: int, flush: int = 1 << 19) -> DataFrame:
    """gram (8 bytes a word, its code) and n of all phrases of 2 to 5 words that occur ``least`` times or more."""
    shared, others = docs.sparkSession.sparkContext.broadcast(ranks), ranks.others

    def route(parts):
        ranks, held, size = shared.value, [], 0

        def packed(held):
            rows, keys, n = _together(np.concatenate([r for r, _ in held]), np.concatenate([n for _, n in held]))
            to = ranks.deal(rows[:, _SIDE], keys)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1)) if len(to) else []
            for cut in np.array_split(order, cuts[1:]) if len(to) else []:
                yield int(to[cut[0]]), _pack(rows[cut], n[cut])

        def out(held):
            got = list(packed(held))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int64()), pa.array([b for _, b in got], pa.binary())], ["part", "blob"])

        for whole in parts:
            for batch in batches(whole, most=2 << 20):
                _, _, _, codes, begins, _, _ = _words(batch)
                rows = fragments(ranks.number(codes, others), begins)
                rows, _, n = _together(rows, np.ones(len(rows), np.int64))
                held.append((rows, n))
                size += len(rows)
                if size >= flush:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    def local(table: pa.Table) -> pa.Table:
        ranks = shared.value
        got = [_unpack(b.as_py()) for b in table["blob"]]
        rows, n = np.concatenate([r for r, _ in got]), np.concatenate([n for _, n in got])
        hot = table["part"][0].as_py() >= ranks.partitions
        grams, counts = [], []
        for g, total in mine(rows, n, 1 if hot else least):
            raw = ranks.code(g).astype(">i8").tobytes()
            width = 8 * g.shape[1]
            grams.append(pa.Array.from_buffers(pa.binary(), len(g), [None, pa.py_buffer(np.arange(0, len(raw) + 1, width, dtype=np.int32)), pa.py_buffer(raw)]))
            counts.append(total)
        return pa.table({"gram": pa.concat_arrays(grams) if grams else pa.array([], pa.binary()), "n": pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))})

    sent = arrow(docs.select("lang", "text"), route, "part long, blob binary")
    mined = grouped(sent, ["part"], local, "gram binary, n long")
    return mined.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _best(d: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """Rows that may be among the first ``most`` of their ``by``, ties included: ranked in parts until few are left."""
    while (n := d.count()) > TOP_ROWS:
        part = F.pmod(F.xxhash64("gram"), F.lit(-(-n // TOP_ROWS) * 2))
        left = d.withColumn("__at", F.rank().over(Window.partitionBy(by, part).orderBy(*order))).where(F.col("__at") <= most).drop("__at")
        d = materialise(left)
        if 2 * d.count() > n:
            break
    return d.withColumn("__at", F.rank().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__at") <= most).drop("__at")


def collocations(docs: DataFrame, least: int = 100, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``most`` best phrases of 2 to 5 words.

    a, l and r are occurrences of the phrase and of the parts of its lowest-scoring cut, n of all words of the language;
    score is floor(1000 a n / (l r)), in decimals of 38 digits. A phrase inside a longer one that occurs as often drops
    out; of several longer ones it is enough to look at those with one word more, which occur at least as often.

    Defined cases: a null lang is "und"; null and empty texts have no words; repeated rows count each time; a language
    without a phrase has no row; an empty table gives an empty one; further columns are ignored.
    """
    spark = docs.sparkSession
    counted = materialise(word_counts(docs, least))
    totals = counted.where("word is null").select("lang", F.xxhash64("lang").alias("lang_key"), F.col("n").alias("total"))
    words = counted.where("word is not null")
    total = totals.agg(F.sum("total")).first()[0] or 0
    partitions = max(2 * shuffle_partitions(spark), -(-total // SIZE))
    grams = materialise(gram_counts(docs, Ranks(words, total, partitions), least))

    single = F.unhex(F.lpad(F.hex("code"), 16, "0"))
    known = words.select(single.alias("part"), F.col("n").alias("f"), F.xxhash64("lang").alias("lang_key")).unionByName(grams.select(F.col("gram").alias("part"), F.col("n").alias("f"), F.lit(None).cast("long").alias("lang_key")))
    size = (F.length("gram") / 8).cast("int")
    sides = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(0).alias("side"), F.substring("gram", F.lit(1), 8 * k).alias("part")),
        F.struct(k.alias("k"), F.lit(1).alias("side"), F.substring("gram", 8 * k + 1, F.length("gram") - 8 * k).alias("part")))))
    parts = grams.select("gram", F.col("n").alias("a"), F.explode(sides).alias("x")).select("gram", "a", "x.*")
    by_part = materialise(parts.groupBy("part").agg(F.count("*").alias("n")).join(known, "part"))
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    cuts = join_hot(parts, by_part, "part").groupBy("gram", "a").agg(
        F.max(F.when((F.col("k") == 1) & (F.col("side") == 0), F.col("lang_key"))).alias("lang_key"), *(of(k, s).alias(f"{'lr'[s]}{k}") for k in range(1, LONGEST) for s in (0, 1)))
    scored = join_hot(cuts, totals.withColumn("n", F.col("total")), "lang_key")
    exact = "cast(cast(a as decimal(20,0)) * cast(total as decimal(18,0)) * cast(1000 as decimal(4,0)) div (cast(l{0} as decimal(20,0)) * cast(r{0} as decimal(18,0))) as long)"
    cut = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(exact.format(k)).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)]
    scored = scored.withColumn("x", F.array_min(F.array_compact(F.array(*cut)))).select("gram", "lang", "a", F.col("total").alias("n"), "x.score", "x.l", "x.r")
    inner = F.explode(F.array(F.substring("gram", F.lit(1), F.length("gram") - 8), F.substring("gram", F.lit(9), F.length("gram") - 8)))
    longer = grams.where(F.length("gram") > 16).select(inner.alias("gram"), F.col("n").alias("longer")).groupBy("gram").agg(F.max("longer").alias("longer"))
    left = materialise(scored.join(longer, "gram", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer"))

    best = _best(left, "lang", [F.desc("score"), F.desc("a")], most)
    at = F.posexplode(F.transform(F.sequence(F.lit(1), size), lambda k: F.substring("gram", 8 * k - 7, F.lit(8))))
    spelt = best.select("gram", at.alias("place", "part")).join(words.select(single.alias("part"), "word"), "part")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ")
    named = best.join(spelt.groupBy("gram").agg(phrase.alias("phrase")), "gram")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
