"""WARC archives as a chunked record table."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.shared import scratch, table, text_bytes

#: Begins every record; readers split archives at it.
MAGIC = b"WARC/1.1\r\n"
#: Payload bytes of one record at most; the rest follows in continuations.
CHUNK = 1 << 16
#: Payloads from this size on are stored once, and revisited by their copies.
MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def pieces(payload: bytes | memoryview, chunk: int = CHUNK) -> Iterator[bytes]:
    """A payload in parts of at most ``chunk`` bytes, at least one; one part is copied at a time.

    No part ends within a character, contains ``MAGIC`` or ends in what the
    line break after a record would complete to it: a part ends inside any
    such string, so no record is mistaken for two.
    """
    view, at = memoryview(payload), 0
    while True:
        end = min(len(view), at + chunk)
        if end < len(view):
            whole = end
            while whole > at and view[whole] & 0xC0 == 0x80:
                whole -= 1
            end = whole if whole > at else end
        part = bytes(view[at:end])
        found = part.find(MAGIC)
        if found >= 0:
            part = part[: found + 5]
        elif part.endswith(MAGIC[:-2]):
            part = part[:-3]
        yield part
        at += len(part)
        if at >= len(view):
            return


def _visible(url: str | None) -> str:
    shown = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    return shown.replace("WARC/1.1", "WARC%2F1.1")  # the line break after it would make it MAGIC


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{copy}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"".join((MAGIC, head.encode(), b"Content-Length: ", str(len(block)).encode(), b"\r\n\r\n", block, b"\r\n"))


def records(page_id: int | None, url: str | None, payload: bytes | memoryview, digest: str, copy: int, refers_to: int | None, revisit: bool, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response and its continuations.

    Every part carries the digest of the payload up to its end.
    """
    own = record_id(page_id, digest, copy)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _visible(url) or None), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", len(payload))]
    if revisit:
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 1)), ("WARC-Refers-To-Page-ID", refers_to)]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *more], b"")
        return
    running, seen = hashlib.sha1(usedforsecurity=False), 0
    for number, part in enumerate(pieces(payload, chunk), 1):
        running.update(part)
        seen += len(part)
        last = seen == len(payload)
        segment = [("WARC-Segment-Number", number), ("WARC-Segment-Digest", f"sha1:{base32(running.digest())}"), ("WARC-Segment-Last", "yes" if last else "no")]
        if number == 1:
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), ("Content-Type", "application/http; msgtype=response"), *common, *segment]
            yield _record(fields, http + part)
        else:
            origin = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, digest, -(copy << 32) - number)), ("WARC-Segment-Origin-ID", own)]
            if last:
                segment.append(("WARC-Segment-Total-Length", len(payload)))
            yield _record([*origin, *common, *segment], part)


def decisions(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each row's payload with its digest and what it is stored as.

    Copies are found by a minimum over digests, which is partially
    aggregated, and payloads are joined with it by page, so a payload with
    very many copies is spread over all partitions.
    """
    payload = text_bytes(html_col)
    page = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("none"))
    rows = pages.select(page.alias("page"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    small = pages.select(page.alias("page"), F.col(id_col).cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    first = small.groupBy("digest").agg(F.min("page_id").alias("first"))
    once = small.groupBy("page", "digest").agg(F.min("bytes").alias("bytes"))
    known = once.join(first, "digest").select("page", "digest", "first", "bytes")
    # the window finds the rows where the join left them, so payloads move once
    joined = rows.join(known, ["page", "digest"])
    copy = F.row_number().over(Window.partitionBy("page", "digest").orderBy("url"))
    revisit = (F.col("bytes") >= min_bytes) & ~(F.col("page_id").eqNullSafe(F.col("first")) & (F.col("copy") == 1))
    return joined.withColumn("copy", copy).select("page_id", "url", "payload", "digest", "copy", "first", revisit.alias("revisit"))


def write(pages: DataFrame, path: str, chunk: int = CHUNK, min_bytes: int = MIN_BYTES, **columns) -> None:
    """Write one archive file for each partition, compressed, by Spark's own writer."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            held = 0
            for row in zip(*(batch.column(k) for k in range(7)), strict=True):
                payload = memoryview(row[2].as_buffer())  # stays in the batch, and is copied part by part
                page, url, digest, copy, first, revisit = (x.as_py() for k, x in enumerate(row) if k != 2)
                for text in records(page, url, payload, base32(bytes.fromhex(digest)), copy, first, revisit, chunk):
                    out.append(text)
                    held += len(text)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = decisions(pages, min_bytes, **columns).mapInArrow(encode, "value binary")
    # the writer ends each row with the second of the two line breaks that end a record
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


CHUNKS = "record string, page_id long, kind string, refers_to long, digest string, bytes long, chunk long, running string, last boolean, data binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for text in batch.column(0):
            raw = text.as_buffer()
            data = memoryview(raw)
            if not len(data):
                continue
            end, reach = -1, 1 << 16
            while end < 0:  # a header is as long as its URL
                end = bytes(data[:reach]).find(b"\r\n\r\n")
                if end < 0 and reach >= len(data):
                    raise ValueError("a record without an end of its header")
                reach *= 4
            head = dict(line.split(": ", 1) for line in bytes(data[:end]).decode().split("\r\n"))
            size = int(head["Content-Length"])
            block = data[end + 4 : end + 4 + size]
            if len(block) != size:
                raise ValueError(f"cut short: {head['WARC-Record-ID']}")
            kind = head["WARC-Type"]
            if kind == "response":
                block = block[bytes(block[: 1 << 12]).find(b"\r\n\r\n") + 4 :]
            number = lambda name: int(head[name]) if name in head else None
            chunk, last = number("WARC-Segment-Number") or 1, head.get("WARC-Segment-Last", "yes") == "yes"
            values = [
                head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]), number("WARC-Page-ID"), kind, number("WARC-Refers-To-Page-ID"),
                head["WARC-Payload-Digest"].removeprefix("sha1:"), number("WARC-Payload-Length"), chunk, head.get("WARC-Segment-Digest", "").removeprefix("sha1:"), last, None,
            ]
            if kind == "response" and last:
                # the whole payload is here: verify it now, and send on no bytes
                if base32(hashlib.sha1(block, usedforsecurity=False).digest()) != values[4] or len(block) != values[5]:
                    raise ValueError(f"damaged: {values[0]}")
            elif kind != "revisit":
                values[9] = bytes(block)
            for to, value in zip(rows, values, strict=True):
                to.append(value)
        if rows[0]:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of an archive: one row for each part of a record.

    ``data`` holds the bytes of parts of records that have several; a record
    of one part is verified as it is read. Rows are bounded by the chunk size,
    whatever the size of the record.
    """
    read = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return read.select(F.col("value").cast("binary").alias("value")).mapInArrow(_parse, CHUNKS)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each record, from chunks in order; holds one digest at a time."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    running, seen, expect = hashlib.sha1(usedforsecurity=False), 0, 1
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for x in batch.to_pylist():
            if x["kind"] == "revisit" or x["data"] is None:
                row = [x["page_id"], x["bytes"], x["digest"], x["kind"], x["refers_to"]]
            else:
                if x["chunk"] == 1:
                    running, seen, expect = hashlib.sha1(usedforsecurity=False), 0, 1
                running.update(x["data"])
                seen += len(x["data"])
                if x["chunk"] != expect or base32(running.digest()) != x["running"]:
                    raise ValueError(f"damaged: {x['record']}, part {x['chunk']}")
                expect += 1
                if not x["last"]:
                    continue
                if seen != x["bytes"] or x["running"] != x["digest"]:
                    raise ValueError(f"damaged: {x['record']}")
                row = [x["page_id"], seen, x["running"], "response", None]
            for to, value in zip(rows, row, strict=True):
                to.append(value)
        if rows[0]:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of an archive.

    Digests of responses are those of the bytes read; a record that differs
    from its headers is an error. Parts of large payloads are brought in order
    by a sort and digested one at a time.
    """
    parts = chunks(spark, path).repartition("record").sortWithinPartitions("record", "chunk")
    return parts.mapInArrow(_verify, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, path: str | None = None, chunk: int = CHUNK, min_bytes: int = MIN_BYTES, **columns) -> DataFrame:
    """Write ``pages`` to WARC archives and return what reading them gives.

    A null payload is empty. Of rows with equal payloads the one with the
    smallest page id is a response, and of repeated rows of that page the
    first; the others are revisits. Null ids come last: they are responses
    only among themselves. An empty table gives empty archives and results.
    Columns other than id, URL and payload are not read.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write(pages, path, chunk, min_bytes, **columns)
    return read(spark, path)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


OP9_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, row_number() OVER () AS rn FROM pages
), d AS (
  SELECT page_id, rn, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
         row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, rn) AS nth
  FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(h || '0', CAST(j * 5 // 4 + 1 AS BIGINT), 2) AS INTEGER) >> CAST(3 - (j * 5) % 4 AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN first END AS refers_to
FROM f
"""
