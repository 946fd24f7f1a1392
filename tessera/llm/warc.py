"""WARC archives: writing captures, reading them back, and transaction assembly.

A capture is three records: the request, the response (or a revisit of an equal payload's response) and metadata. The
request and the metadata name the response in WARC-Concurrent-To. Reading parses archives into records, and assembly
joins the three kinds through these identifiers into one nested row per capture.

Archives are written by Spark's text writer, a record a row, with the blank lines that end a record as the separator,
so they go to any file system that Spark writes to; they are read back as whole files of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, column, join_hot, materialise, shared_dir

#: Records that one archive holds, at most, and bytes that it holds, about.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 4000, 64 << 20
#: Bytes that a reader unpacks at a time, and bytes of records that it hands on at once, about.
STEP = 1 << 20
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DATE = "2020-01-01T00:00:00Z"


def base32(sha1_hex: Column) -> Column:
    """Bare upper-case base32 of 40 hexadecimal digits."""
    parts = []
    for i in range(4):
        number = F.conv(F.substring(sha1_hex, 10 * i + 1, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(_SYMBOLS), (F.shiftright(number, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*parts)


def captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): capture (an identifier of its own), page_id, url, html, payload_bytes,
    payload_digest, refers_to and original (page_id and capture of the equal payload that is kept; null for that one).

    Of equal payloads of at least ``least`` bytes, the row with the smallest (page_id, url) is kept.
    """
    d = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    d = d.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", base32(F.sha1(F.col("html").cast("binary"))))
    light = materialise(d.select("page_id", "url", "payload_digest", "payload_bytes", F.expr("uuid()").alias("capture")))
    order = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("page_id"), F.coalesce("url", F.lit("")).alias("u"), F.col("capture").alias("capture"))
    firsts = light.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("payload_digest", F.col("f.page_id").alias("first_page"), F.col("f.capture").alias("first"), "n")
    marked = join_hot(light, firsts, "payload_digest").withColumn("again", F.col("first").isNotNull() & (F.col("first") != F.col("capture")))
    return marked.select("capture", "page_id", "url", "payload_digest", "payload_bytes", F.when(F.col("again"), F.col("first_page")).alias("refers_to"), F.when(F.col("again"), F.col("first")).alias("original"))


def _plain(c: Column) -> Column:
    """A header value: line breaks and other controls would end it."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00-\x1F\x7F]", " ")


def records(marked: DataFrame, pages: DataFrame) -> DataFrame:
    """WARC records as text, without the line ends that close them.

    Rows of ``marked`` that keep their payload (responses) are joined with the pages, repeated rows once; revisits need
    none.
    """
    crlf = "\r\n"
    http_of = lambda n: F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), n.cast("string"), F.lit(crlf * 2))
    urn = lambda c, kind: F.concat(F.lit(f"<urn:x-capture:{kind}:"), c, F.lit(">"))
    url = _plain(F.col("url"))

    def record(kind: Column | str, key: str, block: Column, media: str, headers: list) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), urn(F.col("capture"), key)), F.lit(f"WARC-Date: {_DATE}"), F.concat(F.lit("WARC-Target-URI: "), url)]
        lines += [F.when(v.isNotNull(), F.concat(F.lit(f"{n}: "), v)) for n, v in headers]
        lines += [F.lit(f"Content-Type: {media}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
        return F.concat(F.concat_ws(crlf, *lines), F.lit(crlf * 2), block)

    concurrent = ("WARC-Concurrent-To", urn(F.col("capture"), "response"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    request = record("request", "request", F.concat(F.lit(f"GET / HTTP/1.1{crlf}X-URI: "), url, F.lit(crlf * 2)), "application/http;msgtype=request", [concurrent])
    metadata = record("metadata", "metadata", F.concat(F.lit("page-id: "), page, F.lit(f"{crlf}page-url: "), url, F.lit(crlf)), "application/warc-fields", [concurrent])
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))
    revisit = record("revisit", "response", http_of(F.col("payload_bytes")), "application/http;msgtype=response", [
        digest, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", urn(F.col("original"), "response"))])
    response = record("response", "response", F.concat(http_of(F.col("payload_bytes")), F.col("html")), "application/http;msgtype=response", [digest])
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    same = lambda page, url, digest: [F.coalesce(F.col(page).cast("string"), F.lit("")).alias("k1"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("k2"), digest.alias("k3")]
    bodies = pages.select(*same("page_id", "url", base32(F.sha1(html.cast("binary")))), html.alias("html"))
    # dealt first: else payloads are sorted to find repeats in each task, and again where they meet
    bodies = bodies.repartition("k1", "k2", "k3").dropDuplicates(["k1", "k2", "k3"])
    kept = marked.where("original is null").select("*", *same("page_id", "url", F.col("payload_digest"))).join(bodies, ["k1", "k2", "k3"])
    return (kept.select(response.alias("record"))
            .unionByName(marked.where("original is not null").select(revisit.alias("record")))
            .unionByName(marked.select(F.explode(F.array(request, metadata)).alias("record"))))


def unpacked(data):
    """Pieces of an archive's content. Gzip members follow one another, a record each or many, and all are read; what
    is not gzipped is handed on as it is. An empty archive has no piece; one that breaks off raises ``ValueError``."""
    data = memoryview(data)
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[i : i + STEP]) for i in range(0, len(data), STEP))
        return
    at = 0
    while at < len(data):
        member, rest = zlib.decompressobj(31), b""
        while not member.eof:
            if not rest and at >= len(data):
                raise ValueError("an archive breaks off inside a gzip member")
            if not rest:
                rest, at = bytes(data[at : at + STEP]), at + STEP
            yield member.decompress(rest, 4 * STEP)
            rest = member.unconsumed_tail
        at = min(at, len(data)) - len(member.unused_data)
        while at < len(data) and data[at] == 0:  # padding between members
            at += 1


def parse(pieces):
    """Headers (lower-case names) and block of each record of an archive, whose content comes in ``pieces``; no more of
    it is held than a record and a piece."""
    held, pieces, gone = bytearray(), iter(pieces), 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while held or more():
        if not held:
            continue
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                break
        if end < 0 or not held.startswith(b"WARC/"):
            raise ValueError(f"no record at {gone}")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        while len(held) < end + 8 + length and more():
            pass
        if held[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"a record at {gone} of another length than it says")
        yield headers, bytes(held[end + 4 : end + 4 + length])
        del held[: end + 8 + length]
        gone += end + 8 + length


_FIELDS = ("type", "record_id", "concurrent_to", "refers_to", "uri", "page_id", "payload_digest")


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records of all archives below ``path``: type, record_id, concurrent_to, refers_to, uri, page_id (metadata's),
    payload_digest (computed for responses, as stated for revisits), payload_bytes, and payload where that is wanted.

    Defined cases: archives of one gzip member, of many, and without compression are read in full; an archive that
    breaks off, a record of another length than it says, and a payload that differs from its digest raise
    ``ValueError``; headers that are missing are null; records of other types are rows too. An archive must fit what
    Spark's binary files allow, 2 GB; rows leave a task in batches of a few megabytes.
    """
    kinds = [pa.string()] * 7 + [pa.int64(), pa.binary()]
    names = [*_FIELDS, "payload_bytes", "payload"]

    def out(rows):
        arrays = [pa.array(c, k) for c, k in zip(rows, kinds)]
        return pa.RecordBatch.from_arrays(arrays if payload else arrays[:-1], names if payload else names[:-1])

    def run(parts):
        for batch in parts:
            for data in column(batch, "content"):
                rows: list[list] = [[] for _ in range(9)]
                size_held = 0
                for h, block in parse(unpacked(data.as_buffer())):
                    kind, page, digest, size, body = h["warc-type"], None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                        size = int(http.get(b"content-length", len(body)))
                        if kind == "response":
                            own = base64.b32encode(hashlib.sha1(body).digest()).decode()
                            if (digest is not None and own != digest) or size != len(body):
                                raise ValueError(f"payload of {h['warc-record-id']} differs from its digest")
                            digest = own
                        else:
                            body = None
                    elif kind == "metadata":
                        page = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x).get("page-id") or None
                    row = (kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), page, digest, size, body if payload else None)
                    for c, x in zip(rows, row):
                        c.append(x)
                    size_held += 300 + (len(body) if payload and body else 0)
                    if size_held > 4 * STEP:
                        yield out(rows)
                        rows, size_held = [[] for _ in range(9)], 0
                if rows[0]:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return arrow(files, run, ", ".join(f"{f} string" for f in _FIELDS) + ", payload_bytes long" + ", payload binary" * payload)


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: response, request and metadata as structs, and original, the record that a revisit refers to.

    Defined cases: a request or metadata record without its response, and a response without the others, is a row too,
    with nulls for what is missing; so is a record that names none (no id); several requests or metadata records of one
    response give a row for each combination; an empty table gives an empty one.
    """
    part = lambda kind: found.where(F.col("type") == kind).select(F.col("concurrent_to").alias("id"), F.struct("record_id", "uri", "page_id").alias(kind))
    main = found.where(F.col("type").isin("response", "revisit"))
    main = main.select(F.col("record_id").alias("id"), F.struct(*[c for c in found.columns if c not in ("concurrent_to", "page_id")]).alias("response"))
    return main.join(part("request"), "id", "full").join(part("metadata"), "id", "full")


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archives of all rows of ``pages``, gzipped, of ARCHIVE_RECORDS records at most and of about ARCHIVE_BYTES."""
    marked = materialise(captures(pages, least))
    n, size = marked.agg(F.count("*"), F.sum(F.when(F.col("original").isNull(), F.col("payload_bytes")).otherwise(0))).first()
    most = max(1, min(ARCHIVE_RECORDS, ARCHIVE_BYTES * 3 * n // ((size or 0) + 3 * 600 * n))) if n else ARCHIVE_RECORDS
    records(marked, pages).write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def round_trip(pages: DataFrame, least: int = 0, payload: bool = False) -> DataFrame:
    """Write ``pages``, read the archives back and assemble: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and with ``payload`` the payload of responses.

    Defined cases: a null html is an empty payload; a null url is an empty one; a null page_id comes back null and is
    larger than any other; of repeated rows (equal page_id and payload) one is the response and the others revisit it;
    line breaks in a url become spaces in the archive; an empty table gives an empty one; further columns are ignored.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/tessera-scratch/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    rows = materialise(assemble(read(spark, path, payload)))
    kind = pages.schema["page_id"].dataType
    rows = rows.select("id", F.col("metadata.page_id").cast(kind).alias("page_id"), "response.*")
    cited = rows.where("refers_to is not null").groupBy("refers_to").agg(F.count("*").alias("n"))
    kept = rows.where("type = 'response'").select(F.col("id").alias("refers_to"), F.col("page_id").alias("__original")).join(cited, "refers_to")
    out = join_hot(rows, kept, "refers_to")
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", F.col("__original")).alias("refers_to"), *(["payload"] if payload else []))
