"""Packing by power-of-two decomposition.

A document's tokens are cut into pieces whose lengths are powers of two, the longest first: as many of the context
length as fit, then one for each binary digit of what is left. Pieces of one length share a bucket, and every piece is
a sequence of its own: nothing is padded and no sequence crosses documents. A batch of training tokens then takes
sequences of one bucket, in the order in which their documents come where that is known.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, batches, column, materialise

#: Pieces after which a task starts another dictionary; the one before is kept beside it until the next start.
REMEMBERED = 250_000
END = 1
_LETTERS, _SPACES = "A-Za-zÀ-ÖØ-öø-ÿ", r" \t-\r"
#: Words with other characters than these are not cut.
_PLAIN = rf"\x00-\x08\x0e-\x1f!-&(-{{}}-\x7f{_LETTERS[6:]}"
_CUT = re.compile(rf"[{_PLAIN}]*+[^{_PLAIN}{_SPACES}][^{_SPACES}]*|[{_LETTERS}]+|[^{_LETTERS}{_SPACES}]+")


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


class _Encoder:
    """Token ids, little-endian unsigned 32-bit, of texts whose pieces are encoded apart, each distinct one once.

    That is the same as encoding whole texts for a tokenizer that drops white space and cuts between runs of letters
    and what else is not white space. Pieces are runs of Latin letters and runs of the rest of ASCII. A word with any
    other character, or with an apostrophe or a bar, which may belong to a contraction or a special token, is one piece.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, pieces: list[str]) -> None:
        """Runs of letters are encoded many at a time: each is one pre-token, whose last token is one that ends a word."""
        for letters in (True, False):
            same = [w for w in pieces if w.isalpha() == letters]
            for at in range(0, len(same), 4096):
                part = same[at : at + 4096]
                if letters:
                    ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                    stops = np.flatnonzero(self.ends[ids]) + 1
                    if len(stops) == len(part) and stops[-1] == len(ids):
                        data = ids.tobytes()
                        stops = (4 * stops).tolist()
                        self.known.update(zip(part, map(data.__getitem__, map(slice, [0, *stops[:-1]], stops))))
                        continue
                for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                    self.known[w] = np.asarray(e.ids, "<u4").tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        split = list(map(_CUT.findall, texts))
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        unknown = []
        for w in set(chain.from_iterable(split)).difference(self.known):
            ids = self.older.get(w)
            if ids is None:
                unknown.append(w)
            else:
                self.known[w] = ids
        self._learn(unknown)
        return [b"".join(map(self.known.__getitem__, row)) for row in split]


def lengths(n: int, context: int) -> list[int]:
    out = [context] * (n // context)
    rest = n % context
    return out + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def in_written_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, and where files were written in order, ``file`` and ``row``, the document's place: the number of the
    file, which Spark gives by partition, and the row in it. Rows that come from no file have doc_id and text only."""
    try:
        found = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs.select("doc_id", "text")
    part = F.regexp_extract("name", r"^part-(\d+)-", 1)
    piece = F.regexp_extract("name", r"^part-\d+-.*?[-.]c(\d+)\.", 1)
    number = F.when(part != "", part.cast("long") * 100_000 + F.coalesce(F.nullif(piece, F.lit("")).cast("long"), F.lit(0)))
    return found.select("doc_id", "text", F.coalesce(number, F.pmod(F.xxhash64("name"), F.lit(1024))).alias("file"), "row")


def decompose(docs: DataFrame, tokenizer: str, context: int = 2048, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit); file and row of
    ``in_written_order`` too, where ``docs`` have them."""
    if context & (context - 1):
        raise ValueError("context must be a power of two")

    def run(parts):
        encoder = _Encoder(tokenizer)
        tail = np.asarray([end], "<u4").tobytes()
        for whole in parts:
            for batch in batches(whole, most=1 << 20):
                texts = [t or "" for t in column(batch, "text").to_pylist()]
                row, start, size, total, ids = [], [], [], [], []
                for i, e in enumerate(encoder.batch(texts)):
                    e += tail
                    n, at = len(e) // 4, 0
                    for m in lengths(n, context):
                        row.append(i)
                        start.append(at)
                        size.append(m)
                        total.append(n)
                        ids.append(e[4 * at : 4 * (at + m)])
                        at += m
                own = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id").take(own), *(pa.array(x, pa.int64()) for x in (start, size, total)), pa.array(ids, pa.binary()), *(column(batch, c).take(own) for c in place)],
                    ["doc_id", "start", "length", "doc_tokens", "ids", *place])

    place = ["file", "row"] if docs.columns == ["doc_id", "text", "file", "row"] else []
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow(docs.select("doc_id", "text", *place), run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary" + "".join(f", {c} long" for c in place))


def sequences(pieces: DataFrame, least_spread: int = 1024) -> DataFrame:
    """``pieces`` with sequence_id (gapless from 0, longest bucket first, in order of file and row where pieces have them)
    and offset (0: a piece is a whole sequence).

    Places in a bucket are counted in two steps, inside parts and over the parts' counts, so that no bucket meets in one
    task. Parts are files, or by a hash of the piece, about 100,000 pieces each; their counts are a row for each part
    and length.
    """
    pieces = materialise(pieces)
    own = [c for c in pieces.columns if c not in ("file", "row")]
    placed = "file" in pieces.columns
    part = F.col("file") if placed else F.pmod(F.xxhash64(*own), F.lit(max(least_spread, pieces.count() // 100_000)))
    d = pieces.select(F.struct(*own).alias("piece"), "length", part.alias("part"), F.col("row") if placed else F.xxhash64(*own).alias("row"))
    counts = d.groupBy("length", "part").agg(F.count("*").alias("n"))
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n"))
    longer = by_length.select("length", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("longer"))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")).join(F.broadcast(longer), "length")
    inside = Window.partitionBy("length", "part").orderBy("row", "piece.start", "piece")
    d = d.withColumn("nth", F.row_number().over(inside) - 1).join(counts.withColumnRenamed("length", "l").withColumnRenamed("part", "p"), (F.col("l") == F.col("length")) & (F.col("p") == F.col("part")))
    return d.select("piece.*", (F.col("longer") + F.col("before") + F.col("nth")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, context: int = 2048, end: int = END, digest: bool = False) -> DataFrame:
    """All pieces of all documents with their sequences; with ``digest``, ids_crc32 in place of ids. Sequences of one
    length follow the order in which files hold the documents.

    Defined cases: a null or empty text is the end token alone, one piece of length 1; null doc_ids and repeated rows
    are documents like others; an empty table gives an empty one; further columns are ignored.
    """
    pieces = decompose(in_written_order(docs), tokenizer, context, end)
    if digest:
        pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", *pieces.columns[5:])
    return sequences(pieces)
