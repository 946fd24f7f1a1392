"""What several operators share: scratch tables in the cluster's shared folder, word hashing over Arrow buffers,
and a shuffle of packed hash entries.

Word hashing works on the UTF-8 bytes of a whole Arrow batch at once. A word is a maximal run of bytes other than
0x20 and 0x09-0x0D, which for UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..deploy import ship

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
#: Bytes that pass to or from a Python worker at once.
ARROW_BYTES = str(8 << 20)
_LOCAL: dict[str, str | None] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table below ``sf_dir``, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a fresh one on this
    machine if Spark runs on it alone; on a cluster that would be lost with an executor, so it raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = _LOCAL.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="tessera-")
        _LOCAL[spark.sparkContext.applicationId] = where
    return where


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it: lineage ends there, and a lost executor costs nothing.

    Tables lie under ``tessera-scratch/<application id>``, which may be deleted once the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-scratch/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Let the driver drop what finished rounds of an iteration held. Their shuffle files, broadcasts and compiled plans go
    only once the driver's garbage is collected, for which Spark itself waits half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_hot(rows: DataFrame, by_key: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """``rows`` left-joined with ``by_key``, which has each key once and n, how many rows it may meet; n is left out.

    Keys with over a ``share``-th of the sum of n, which are fewer than ``share``, are broadcast: their rows are not
    shuffled, so that none of them gathers in one task. The others are joined as usual.
    """
    from pyspark.sql import functions as F

    total = by_key.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(by_key.where(F.col("n") * share > total).drop("n"))
    there = rows.join(hot, key)
    rest = rows.join(hot.select(key), key, "left_anti").join(by_key.where(F.col("n") * share <= total).drop("n"), key, "left")
    return there.unionByName(rest)


def hashed_sample(df: DataFrame, most: int, *keys: str, seed: int = 17, cut: bool = True) -> DataFrame:
    """At most ``most`` rows, the same on every run: all of them, or those whose hash lies under a bound set by the count.

    No rows are sorted or gathered to choose; the bound aims five standard deviations low, and what still passes ``most``
    is cut. Rows with equal keys are in or out together: without ``cut`` the caller takes each of them once.
    """
    from pyspark.sql import functions as F

    n = df.count()
    if n <= most:
        return df
    bound = int(max(0.5 * most, most - 5 * most**0.5) / n * (1 << 40))
    some = df.where(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) < bound)
    return some.limit(most) if cut else some


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = splitmix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _BLOCK + 1)
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base & _MASK, _U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=_U))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def _cut(data: np.ndarray, offs: np.ndarray, pos: int, end: int, space: np.ndarray) -> int:
    """The last place in (pos, end] where no word is cut, or the first one after it."""
    n = len(data)
    if end >= n:
        return n
    spaces = np.flatnonzero(space[data[pos:end]])
    best = pos + int(spaces[-1]) + 1 if len(spaces) else pos
    k = int(np.searchsorted(offs, end, "right")) - 1
    best = max(best, int(offs[k]))
    if best > pos:
        return best
    stop = int(offs[k + 1]) if k + 1 < len(offs) else n
    while end < stop:
        spaces = np.flatnonzero(space[data[end : min(end + _BLOCK, stop)]])
        if len(spaces):
            return end + int(spaces[0]) + 1
        end += _BLOCK
    return stop


def hash_words(data: np.ndarray, offs: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) and 64-bit hashes of all words, and each document's first word's place (documents + 1).

    ``lower`` folds A-Z only; ``space`` says which of the 256 bytes part words. Works through blocks of about 1 MB, so memory does not follow the longest document.
    """
    feed = _BYTES_LOWER if lower else _BYTES
    starts, ends, hashes = [], [], []
    pos, n = 0, len(data)
    while pos < n:
        end = _cut(data, offs, pos, min(pos + _BLOCK, n), space)
        part = data[pos:end]
        m = len(part)
        inside = ~space[part]
        edge = np.zeros(m + 1, bool)
        own = offs[np.searchsorted(offs, pos) : np.searchsorted(offs, end, "right")] - pos
        edge[own] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:m]
        last[:-1] &= ~inside[1:] | edge[1:m]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        p, inv = _powers(m + 1)
        total = np.zeros(m + 1, _U)
        np.cumsum(feed[part] * p[:m], out=total[1:])
        hashes.append(splitmix((total[e] - total[s]) * inv[s] + (e - s).astype(_U)))
        starts.append(s + pos)
        ends.append(e + pos)
        pos = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(len(offs), np.int64)
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(s, offs).astype(np.int64)


def shingle(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, in order; a place at a document's end also looks into the next one."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _U(0xA24BAED4963EE407)
        acc += h[j : j + n]
    return splitmix(acc)


def text_hash(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each document's whole bytes, for telling rows with one doc_id apart."""
    out = np.zeros(len(offs) - 1, _U)
    for i in range(len(offs) - 1):
        acc, a, b = _U(b_ := int(offs[i + 1] - offs[i])), int(offs[i]), int(offs[i + 1])
        for at in range(a, b, _BLOCK):
            part = data[at : min(at + _BLOCK, b)]
            p, _ = _powers(len(part) + 1)
            acc = splitmix(np.asarray([acc], _U) + (_BYTES[part] * p[: len(part)]).sum(dtype=_U))[0]
        out[i] = acc
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batches(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20):
    """Slices of a record batch with about ``most`` bytes of text each, at least one row."""
    col = batch.column(batch.schema.get_field_index(text))
    if len(col) == 0:
        return
    _, offs = utf8(col)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ids(col: pa.Array, null: int = -(1 << 63)) -> np.ndarray:
    """Integer ids as int64, nulls as ``null``."""
    return np.asarray(col.cast(pa.int64()).fill_null(null))


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors, over batches of at most ARROW_BYTES."""
    ship(df.sparkSession)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(limit, None) != ARROW_BYTES:
        df.sparkSession.conf.set(limit, ARROW_BYTES)

    def tidy(parts):
        yield from run(parts)
        release_memory()

    return df.mapInArrow(tidy, schema)


def grouped(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """``df.groupBy(*keys).applyInArrow``; a worker gives memory back after a large group."""
    ship(df.sparkSession)

    def tidy(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes > 1 << 20:
            del table
            release_memory()
        return out

    return df.groupBy(*keys).applyInArrow(tidy, schema)


def release_memory() -> None:
    """Give memory that this worker no longer uses back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Bloom:
    """A bit set of fixed size over integer keys: no key is missed, some others pass.

    It only spares shuffles; results never depend on it. Its size (``bits``, 8 MB) bounds what the driver
    collects and broadcasts at any input size.
    """

    bits = 1 << 26

    def __init__(self, keys: DataFrame, name: str, hashed: bool = False):
        """``hashed``: the keys are hashes themselves, not negative, and ``test`` takes them as they are."""
        from pyspark.sql import functions as F

        h = keys.select((F.col(name) if hashed else F.xxhash64(F.col(name))).alias("h"))
        packed = (
            h.select(F.shiftright(F.pmod("h", F.lit(self.bits)), 6).alias("w"), F.expr("shiftleft(1L, cast(pmod(h, 64) as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b"))
        )
        words = np.zeros(self.bits // 64, np.int64)
        got = packed.toArrow()
        words[np.asarray(got["w"].combine_chunks())] = np.asarray(got["b"].combine_chunks())
        self._spark = keys.sparkSession
        self._words = self._spark.sparkContext.broadcast(words)

    def test(self):
        """A function for use inside tasks: which of an array of hashes, ``Bloom.hash`` of keys, may be in the set."""
        words = self._words

        def may_hold(x: np.ndarray) -> np.ndarray:
            return ((words.value[np.mod(x, Bloom.bits) >> 6] >> np.mod(x, 64)) & 1).astype(bool)

        return may_hold

    @staticmethod
    def hash(name: str):
        from pyspark.sql import functions as F

        return F.xxhash64(F.col(name))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Rows of ``df`` whose key, which must not be null, may be in the set."""
        return df.where(self._may_hold(name))

    def drop(self, df: DataFrame, name: str) -> DataFrame:
        """The other rows: their key is certainly not in the set."""
        return df.where(~self._may_hold(name))

    def _may_hold(self, name: str):
        from pyspark.sql import functions as F

        test = self.test()
        ship(self._spark)

        @F.pandas_udf("boolean")
        def may_hold(h):
            import pandas as pd

            return pd.Series(test(h.to_numpy()))

        # else the optimizer also applies it to what the rows are joined with
        return may_hold.asNondeterministic()(self.hash(name))
