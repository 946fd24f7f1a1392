"""Substring dedup over a log-structured fingerprint index.

A window is ``k`` consecutive words of one document; its fingerprint is a 64-bit hash. The index is a list of immutable
runs on disk: for every part of the hash space the fingerprints of earlier batches, sorted. A new batch is cut into
shares by its tasks: for every part the fingerprints of the share, each once with the smallest document that has it, so
one passage in a third of all documents counts once a share. A part's shares are merged, and joined with its runs: a
fingerprint that a smaller document or an earlier batch has too marks its window. The same merge gives the batch's own
sorted run, compacted with the runs that it may not stand beside: run sizes grow as the digits of a binary counter do,
so a fingerprint is rewritten a logarithmic number of times.

What a share knows already (a window that a smaller document of the same share has) never leaves as a fingerprint, only
as a mark. Marks name places; the windows there are hashed again in the document itself, and all windows of the document
with such a fingerprint go. Texts move only for documents that may have marks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, arrow, batches, column, grouped, hash_words, materialise, shingle, shuffle_partitions, splitmix, utf8

_U = np.uint64
#: Words of a share, about, and fingerprints of a part, at most about.
SHARE, PART = 400_000, 2_000_000
LAST = (1 << 63) - 1
_ENTRY = "part int, kind int, n int, hashes binary, meta binary"
#: Kinds of entries: a share's fingerprints, its own marks, a run that is looked up, and one that is compacted as well.
FOUND, MARKS, RUN, MERGED = 0, 1, 2, 3
#: Shares of the documents, by ascending doc_id, that come as batches of their own before the rest.
HISTORY = (0.125, 0.125)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays, byte planes apart, compressed."""
    import zstandard

    planes = [np.frombuffer(np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], "<i8").tobytes(), np.uint8)]
    planes += [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).ravel() for a in arrays if len(a)]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def expand(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    count = int(raw[:8].view("<i8")[0])
    sizes = raw[8 : 8 + 16 * count].view("<i8").reshape(-1, 2)
    at, out = 8 + 16 * count, []
    for n, width in sizes:
        part = raw[at : at + n * width].reshape(int(width), int(n))
        out.append(np.ascontiguousarray(part.T).ravel().view(f"<i{width}"))
        at += n * width
    return out


def _windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all windows, their documents and their places."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return shingle(h, k)[first[:-1][doc] + pos], doc, pos


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and id: doc_id, a null one last."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"))


def repeated_ids(docs: DataFrame) -> Bloom:
    """Ids that several rows of ``keyed`` rows share. Such rows are told apart by a mark, 64 bits of their text's hash; other rows' mark is 0."""
    return Bloom(docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "id")


def shares(docs: DataFrame, repeated: Bloom, parts: int, k: int) -> DataFrame:
    """A row for each share of the batch and part: fingerprints with their smallest document, and the marks that the
    share finds itself. ``docs`` are ``keyed`` rows."""
    several = repeated.test()

    def flush(share):
        wh, doc, pos = (np.concatenate(x) for x in list(zip(*share))[:3])
        ids, marks = (np.concatenate(x) for x in list(zip(*share))[3:])
        share.clear()
        _, rank = np.unique(ids, return_inverse=True)
        order = np.lexsort((doc, rank[doc], wh))
        h, d = wh[order], doc[order]
        new = np.r_[True, h[1:] != h[:-1]][: len(h)]
        once = new | np.r_[True, d[1:] != d[:-1]][: len(h)]  # a document's first window of each fingerprint
        order, h, d, new = order[once], h[once], d[once], new[once]
        least = rank[d][np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else rank[:0]
        found = rank[d] > least
        part = ((h >> _U(32)) % _U(parts)).astype(np.int64)
        for wanted in (False, True):
            take = np.flatnonzero(found == wanted)
            take = take[np.lexsort((order[take], part[take]))]  # by part, then in the share's own order
            bounds = np.flatnonzero(np.r_[True, np.diff(part[take]) > 0]) if len(take) else []
            for a, b in zip(bounds, [*bounds[1:], len(take)]):
                t = take[a:b]
                rows, at = np.unique(d[t], return_inverse=True)
                p = pos[order[t]].astype(np.int32)
                meta = squeeze(np.diff(at.astype(np.int32), prepend=np.int32(0)), np.diff(p, prepend=np.int32(0)), np.diff(ids[rows], prepend=np.int64(0)), marks[rows])
                yield int(part[t[0]]), int(wanted), len(t), b"" if wanted else h[t].tobytes(), meta

    def rows(found):
        held, size = [[] for _ in range(5)], 0
        for row in found:
            for c, x in zip(held, row):
                c.append(x)
            size += len(row[3]) + len(row[4])
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "kind", "n", "hashes", "meta"])
                held, size = [[] for _ in range(5)], 0
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "kind", "n", "hashes", "meta"])

    def run(whole_parts):
        share, words, docs_so_far = [], 0, 0
        for whole in whole_parts:
            for batch in batches(whole):
                data, offs = utf8(column(batch, "text"))
                _, _, h, first = hash_words(data, offs)
                wh, doc, pos = _windows(h, first, k)
                share.append((wh, doc + docs_so_far, pos.astype(np.int32), np.asarray(column(batch, "id")), np.where(several(np.asarray(column(batch, "hash"))), np.asarray(column(batch, "mark")), 0)))
                words += len(wh)
                docs_so_far += batch.num_rows
                if words >= SHARE:
                    yield from rows(flush(share))
                    words = docs_so_far = 0
        if share:
            yield from rows(flush(share))

    return arrow(docs.select("text", "id", Bloom.hash("id").alias("hash"), F.xxhash64("text").alias("mark")), run, _ENTRY)


def _sorted_run(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob)[0].view(_U), dtype=_U)


def look_up(entries: DataFrame, buckets: int, keep: bool) -> DataFrame:
    """Of a batch's shares and the index's runs together: kind MARKS, a row for each part and bucket of documents with the
    windows that a smaller document or a run has too; with ``keep``, kind RUN, a part's new sorted run.

    A part's marks leave it in a row for each bucket of documents, so rows follow parts and not documents times parts.
    """

    def merge(table: pa.Table) -> pa.Table:
        found, hashes, ids, sources, runs, merged, base = [], [], [], [], [], [], 0
        for kind, h, meta in zip(table["kind"].to_pylist(), table["hashes"], table["meta"].to_pylist()):
            if kind in (RUN, MERGED):
                runs.append(_sorted_run(h.as_py()))
                if kind == MERGED:
                    merged.append(runs[-1])
                continue
            at, pos, doc_ids, marks = expand(meta)
            at, pos, doc_ids = np.cumsum(at), np.cumsum(pos), np.cumsum(doc_ids)
            if kind == MARKS:
                found.append((doc_ids[at], marks[at], pos.astype(np.int32)))
            else:
                hashes.append(np.frombuffer(h.as_buffer(), _U))
                ids.append(doc_ids[at])
                sources.append((base, at, pos.astype(np.int32), doc_ids, marks))
                base += len(at)
        keys = np.zeros(0, _U)
        if hashes:
            h, i = np.concatenate(hashes), np.concatenate(ids)
            order = np.argsort(h, kind="stable")
            begin = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]][: len(h)])
            keys = h[order][begin]
            least = np.minimum.reduceat(i[order], begin) if len(h) else i
            known = np.zeros(len(keys), bool)
            for r in runs:
                if len(r):
                    known |= r[np.minimum(np.searchsorted(r, keys), len(r) - 1)] == keys
            least = np.where(known, -LAST - 1, least)
            smallest = np.empty(len(h), np.int64)
            smallest[order] = np.repeat(least, np.diff(np.r_[begin, len(h)]))
            for base, at, pos, doc_ids, marks in sources:
                f = ((i > smallest) | (smallest == -LAST - 1))[base : base + len(at)]
                found.append((doc_ids[at[f]], marks[at[f]], pos[f]))
        ids, marks, pos = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        bucket = (splitmix(ids.view(_U) ^ splitmix(marks.view(_U))) % _U(buckets)).astype(np.int32)
        order = np.lexsort((pos, marks, ids, bucket))
        edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]) if len(order) else np.zeros(0, np.int64)
        blobs = [squeeze(ids[t], marks[t], pos[t]) for t in np.split(order, edges[1:])] if len(edges) else []
        kinds, places, sizes = [MARKS] * len(blobs), bucket[order][edges].tolist(), [0] * len(blobs)
        if keep:
            keys = np.unique(np.concatenate([keys, *merged]))
            kinds, places, sizes, blobs = [*kinds, RUN], [*places, table["part"][0].as_py()], [*sizes, len(keys)], [*blobs, squeeze(np.diff(keys, prepend=_U(0)).view(np.int64))]
        return pa.table({"kind": pa.array(kinds, pa.int32()), "place": pa.array(places, pa.int32()), "n": pa.array(sizes, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return grouped(entries, ["part"], merge, "kind int, place int, n int, blob binary")


def places_of(marks: DataFrame) -> DataFrame:
    """id, mark, places (little-endian 32-bit integers), once a document."""

    def unite(table: pa.Table) -> pa.Table:
        ids, marks, pos = (np.concatenate(x) for x in zip(*map(expand, table["blob"].to_pylist())))
        order = np.lexsort((pos, marks, ids))
        ids, marks, pos = ids[order], marks[order], pos[order]
        begin = np.flatnonzero(np.r_[True, (np.diff(ids) != 0) | (np.diff(marks) != 0)])
        offsets = (np.r_[begin, len(ids)] * 4).astype(np.int32)
        places = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pos.astype("<i4").tobytes())])
        return pa.table({"id": pa.array(ids[begin]), "mark": pa.array(marks[begin]), "places": places})

    return grouped(marks.where(F.col("kind") == MARKS), ["place"], unite, "id long, mark long, places binary")


class Index:
    """Runs of earlier batches, each a table with a row for each part; ``parts`` and ``k`` are the same for all of them.

    ``add`` takes a batch whose doc_ids are larger than those of all batches before it.
    """

    def __init__(self, parts: int, k: int = 13, runs: list[tuple[int, DataFrame]] | None = None):
        self.parts, self.k, self.runs = parts, k, list(runs or [])

    def add(self, docs: DataFrame, repeated: Bloom | None = None, keep: bool = True) -> DataFrame:
        """Marks of a batch (for ``places_of``) against itself and the index; with ``keep``, it becomes a run, which takes in
        the runs of levels 0, 1, 2, ... as far as these are there, and leaves one on the next level."""
        rows = keyed(docs)
        entries = shares(rows, repeated or repeated_ids(rows), self.parts, self.k)
        level = 0
        for at, run in sorted(self.runs, key=lambda r: r[0]):
            joins = keep and at == level
            level += joins
            kind = MERGED if joins else RUN
            entries = entries.unionByName(run.select("part", F.lit(kind).alias("kind"), "n", "hashes", F.lit(None).cast("binary").alias("meta")))
        out = materialise(look_up(entries.repartition(self.parts, "part"), self.parts, keep))
        if keep:
            new = out.where(F.col("kind") == RUN).select(F.col("place").alias("part"), "n", F.col("blob").alias("hashes"))
            self.runs = [(at, run) for at, run in self.runs if at >= level] + [(level, new)]
        return out

    def save(self, path: str) -> None:
        spark = self.runs[0][1].sparkSession if self.runs else None
        if spark is None:
            raise ValueError("an index without a run has nothing to save")
        tables = [run.select(F.lit(self.parts).alias("parts"), F.lit(self.k).alias("k"), F.lit(at).alias("level"), "part", "n", "hashes") for at, run in self.runs]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        out.write.parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Index:
        rows = spark.read.parquet(path)
        made = rows.select("parts", "k").distinct().collect()
        if len(made) != 1:
            raise ValueError("runs of one index are made with one number of parts and one length of windows")
        levels = sorted(r.level for r in rows.select("level").distinct().collect())
        return cls(made[0].parts, made[0].k, [(at, rows.where(F.col("level") == at).select("part", "n", "hashes")) for at in levels])


def parts_for(docs: DataFrame) -> int:
    """Parts of the hash space for about PART fingerprints each, if a word takes four bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-int(size) // (4 * PART)))


def remove(docs: DataFrame, k: int = 13, index: Index | None = None, parts: int | None = None, history: tuple[float, ...] = (), text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and with ``text`` the kept words joined by spaces.

    A word goes if it lies in a window of ``k`` words that also starts in a document with a smaller doc_id, here or in
    ``index``, whose documents count as smaller. With ``history``, ``docs`` come as several batches by ascending doc_id,
    these shares of them first, and the index takes in each batch before the next; the result is the same.

    Defined cases: a null or empty text has no words and its digest is that of nothing; texts of under ``k`` words lose
    nothing; rows with equal doc_id do not remove each other's words; a null doc_id is larger than all others; an empty
    table gives an empty one; further columns are ignored.
    """
    docs = keyed(docs)
    index = Index(index.parts, index.k, index.runs) if index else Index(parts or parts_for(docs), k)
    if index.k != k:
        raise ValueError(f"the index holds windows of {index.k} words")
    repeated = repeated_ids(docs)
    at = [sum(history[: i + 1]) for i in range(len(history))]
    cuts = sorted(set(docs.where(F.col("id") < LAST).agg(F.percentile_approx("id", at, 10_000)).first()[0] or [])) if at else []
    marks = None
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        batch = docs if lo is None else docs.where(F.col("id") > lo)
        found = index.add(batch if hi is None else batch.where(F.col("id") <= hi), repeated, keep=hi is not None)
        marks = found if marks is None else marks.unionByName(found)
    grouped_ = materialise(places_of(marks))
    touched = Bloom(grouped_, "id")
    is_touched, is_repeated = touched.test(), repeated.test()

    @F.pandas_udf("int")
    def state(h):
        """0: no marks; 1: there may be marks; 2: and other rows may have the id."""
        import pandas as pd

        x = h.to_numpy()
        return pd.Series(np.where(is_touched(x), 1 + is_repeated(x), 0).astype(np.int32))

    def digest(parts_):
        for whole in parts_:
            if "hash" in whole.schema.names:
                whole = whole.filter(pa.array(~is_touched(np.asarray(column(whole, "hash")))))
            for batch in batches(whole):
                data, offs = utf8(column(batch, "text"))
                texts = data.tobytes()
                lists = column(batch, "places").to_pylist() if "places" in batch.schema.names else [None] * batch.num_rows
                n, gone, sha, left = [], [], [], []
                for i, found in enumerate(lists):
                    words = texts[offs[i] : offs[i + 1]].split()
                    n.append(len(words))
                    removed = 0
                    if found:
                        one = data[offs[i] : offs[i + 1]]
                        _, _, h, _ = hash_words(one, np.array([0, len(one)]))
                        wh = shingle(h, k)
                        at = np.frombuffer(found, "<i4")
                        hit = np.flatnonzero(np.isin(wh, wh[at]))
                        cover = np.zeros(len(words) + 1, np.int64)
                        np.add.at(cover, hit, 1)
                        np.add.at(cover, np.minimum(hit + k, len(words)), -1)
                        keep = np.cumsum(cover[:-1]) == 0
                        removed = int(len(words) - keep.sum())
                        words = [w for w, x in zip(words, keep) if x]
                    gone.append(removed)
                    kept = b" ".join(words)
                    sha.append(hashlib.sha256(kept).hexdigest())
                    if text:
                        left.append(kept.decode("utf-8", "replace"))
                arrays = [column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())] + ([pa.array(left, pa.string())] if text else [])
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * text)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", text string" * text
    # else the optimizer also applies the test to what the rows are joined with
    near = docs.withColumn("state", state.asNondeterministic()(Bloom.hash("id"))).where("state > 0")
    near = near.withColumn("mark", F.when(F.col("state") == 2, F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    near = near.join(grouped_, ["id", "mark"], "left").select("doc_id", "text", "places")
    return arrow(near, digest, schema).unionByName(arrow(docs.select("doc_id", "text", Bloom.hash("id").alias("hash")), digest, schema))
