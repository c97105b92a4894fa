"""WARC archives: pages are written as records, long ones in segments, and read back whole.

Writing.  Of pages with equal payloads of at least ``min_revisit_bytes`` bytes one is a ``response`` record, the others
are ``revisit`` records that refer to it and hold no payload.  A payload travels as an HTTP response in chunked transfer
framing; a record block longer than ``segment_bytes`` is cut into a first record and ``continuation`` records with
WARC-Segment-Origin-ID, WARC-Segment-Number and, on the last, WARC-Segment-Total-Length.  Files are written by Spark's text
sink with the record end as its line separator, so any file system and codec that Spark knows will do.

Reading.  The text source splits files at ``\\r\\nWARC/1.`` (the writer never leaves that inside a block: it ends a chunk
within it), so an uncompressed archive of any size is read by many tasks and no file is held whole.  A record that is
shorter than its Content-Length tells that a block held the separator: such a file, and only it, is walked record by
record instead.  Continuation records are grouped by origin identifier, ordered by segment number, their total length is
verified, and then the chunked framing is decoded.  Nothing but records with segments, and the narrow rows that revisits
are resolved with, is exchanged.

Defined cases: a NULL payload is empty.  Ties: of equal payloads the smallest page_id is the response (a NULL page_id
sorts last), then the smallest url, then any one; of rows that repeat entirely one is the response and the others revisit
it.  A NULL url or page_id leaves its field out.  A record whose segments are incomplete, do not add up or do not decode
has a NULL payload and says why in ``problem``; a revisit of a record that is not there says so too.  A segment that comes
twice counts once.  An empty table writes an empty archive, which reads as no record.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Blocks above this are written in segments; chunks of the transfer framing hold at most this many bytes.
SEGMENT_BYTES, CHUNK_BYTES = 1 << 14, 1 << 12
#: The separator that a block must not hold, the record end, the HTTP head and the profile of a revisit.
MARK, RECORD_END = "\r\nWARC/1.", "\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD_SCHEMA = ("record_id string, record_type string, page_id long, target_uri string, refers_to string, origin_id string, "
                 "segment_number long, total_length long, content_length long, declared_digest string, block binary")
DECODED_SCHEMA = ("record_id string, record_type string, page_id long, target_uri string, refers_to string, segment_number long, "
                  "origin_id string, total_length long, block binary, payload_bytes long, payload_digest string, payload binary, problem string")


def base32_sha1(sha1_hex: Column) -> Column:
    """The base32 text of a SHA-1 given in hex: five hex digits are four base32 digits."""
    groups = [F.lpad(F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# --- framing --------------------------------------------------------------------------------------------------------

def chunked(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing; no chunk holds the separator of records."""
    mark, out, at = MARK.encode(), [], 0
    while at < len(payload):
        to = min(at + chunk_bytes, len(payload))
        # the line end of the chunk size counts: with a chunk's first bytes it may make the separator
        met = (b"\r\n" + payload[at:to]).find(mark)
        if met >= 0:
            to = at + met + 2
        out.append(b"%X\r\n%s\r\n" % (to - at, payload[at:to]))
        at = to
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("framing: no chunk size")
        digits = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", digits):
            raise ValueError("framing: chunk size")
        size, at = int(digits, 16), end + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("framing: chunk end")
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response; any other block is its own payload."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not gap:
        return block
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head) else body


# --- writing --------------------------------------------------------------------------------------------------------

def _identifier(uid: Column, run: str) -> Column:
    h = F.md5(F.concat(F.lit(run + ":"), uid.cast("string")))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _first_of_equals(pages: DataFrame, min_revisit_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Responses (with payload) and revisits (with the record they refer to)."""
    run, payload = uuid.uuid4().hex, F.coalesce(F.col("html"), F.lit(""))
    # the number of a row is drawn once and stored, so that rows that repeat entirely can be told apart
    rows = stored(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha1(payload.cast("binary")).alias("sha"),
                               F.octet_length(payload).alias("size"), F.monotonically_increasing_id().alias("uid"))
                  .withColumn("record_id", _identifier(F.col("uid"), run)), "warc-rows")
    order = F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNull().alias("b"), "url", "uid", "record_id")
    # a payload that is too small for revisits is a group of its own
    key = F.when(F.col("size") < min_revisit_bytes, F.concat("sha", F.lit("/"), F.col("uid").cast("string"))).otherwise(F.col("sha"))
    keyed = rows.withColumn("key", key)
    firsts = keyed.groupBy("key").agg(F.min(order).alias("first"), F.first("sha").alias("sha"))
    bodies = pages.select(payload.alias("body")).groupBy(F.sha1(F.col("body").cast("binary")).alias("sha")).agg(F.first("body").alias("body"))
    responses = firsts.join(bodies, "sha").select("first.record_id", "first.page_id", "first.url", "sha", "body")
    revisits = keyed.join(firsts.select("key", F.col("first.uid").alias("first_uid"), F.col("first.record_id").alias("refers_to"),
                                        F.col("first.url").alias("refers_to_url")), "key") \
        .filter("uid != first_uid").select("record_id", "page_id", "url", "sha", "refers_to", "refers_to_url")
    return responses, revisits


def _field(name: str, value: Column) -> Column:
    # a line end inside a value would end the field
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n"))


def _head(kind: str, *fields: tuple[str, Column]) -> Column:
    common = [("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.lit(">"))), ("WARC-Date", F.lit(DATE)),
              ("Content-Type", F.lit("application/http;msgtype=response"))]
    return F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"), *(F.coalesce(_field(n, v), F.lit("")) for n, v in (*common, *fields)))


def warc_records(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = 0) -> DataFrame:
    """One row (record) per WARC record of the pages (page_id, url, html), without the record end."""
    responses, revisits = _first_of_equals(pages, min_revisit_bytes)
    described = (("WARC-Target-URI", F.col("url")), ("Page-Id", F.col("page_id").cast("string")),
                 ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("sha")))))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head, rid, body in zip(*(batch.column(c).to_pylist() for c in ("head", "record_id", "body"))):
                block = HTTP_HEAD + chunked(body, chunk_bytes)
                cuts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                out = [b"%sContent-Length: %d\r\n%s\r\n%s" % (head, len(cuts[0]), b"WARC-Segment-Number: 1\r\n" if cuts[1:] else b"", cuts[0])]
                for i, cut in enumerate(cuts[1:], 2):
                    own = uuid.uuid5(uuid.UUID(rid), str(i))
                    last = b"WARC-Segment-Total-Length: %d\r\n" % len(block) if i == len(cuts) else b""
                    out.append(f"WARC/1.1\r\nWARC-Type: continuation\r\nWARC-Record-ID: <urn:uuid:{own}>\r\nWARC-Date: {DATE}\r\n"
                               f"WARC-Segment-Origin-ID: <urn:uuid:{rid}>\r\nWARC-Segment-Number: {i}\r\nContent-Length: {len(cut)}\r\n".encode() + last + b"\r\n" + cut)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    whole = responses.select(_head("response", *described).cast("binary").alias("head"), "record_id", F.col("body").cast("binary").alias("body")) \
        .mapInArrow(records, "record binary")
    referring = _head("revisit", *described, ("WARC-Profile", F.lit(REVISIT_PROFILE)),
                      ("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), F.col("refers_to"), F.lit(">"))), ("WARC-Refers-To-Target-URI", F.col("refers_to_url")))
    http = HTTP_HEAD.decode()
    return whole.select(F.col("record").cast("string").alias("record")).unionByName(revisits.select(
        F.concat(referring, F.lit(f"Content-Length: {len(http)}\r\n\r\n{http}")).alias("record")))


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", **params) -> None:
    """Write the pages as WARC files into the folder `path`."""
    warc_records(pages, **params).write.option("lineSep", RECORD_END).option("compression", compression).text(path)


# --- reading --------------------------------------------------------------------------------------------------------

def _records(value: Column, rows: DataFrame) -> DataFrame:
    """The fields and block of records given as text from the version on."""
    raw = rows.select("file", value.alias("value")).withColumn("__head", F.substring_index("value", RECORD_END, 1))
    named = raw.select("file", "value", F.octet_length("__head").alias("skip"),
                       F.concat(F.regexp_replace("__head", r"\r\n[ \t]+", " "), F.lit("\r\n")).alias("head"))

    def field(name: str) -> Column:
        got = F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*?)[ \t]*\r\n", 1)
        return F.when(got != "", got)

    def urn(name: str) -> Column:
        return F.regexp_replace(field(name), "^<|>$", "")

    length = F.coalesce(field("Content-Length").try_cast("long"), F.lit(0))
    return named.select(
        "file", urn("WARC-Record-ID").alias("record_id"), F.lower(field("WARC-Type")).alias("record_type"), field("Page-Id").try_cast("long").alias("page_id"),
        urn("WARC-Target-URI").alias("target_uri"), urn("WARC-Refers-To").alias("refers_to"), urn("WARC-Segment-Origin-ID").alias("origin_id"),
        field("WARC-Segment-Number").try_cast("long").alias("segment_number"), field("WARC-Segment-Total-Length").try_cast("long").alias("total_length"),
        length.alias("content_length"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("declared_digest"),
        F.substring(F.col("value").cast("binary"), F.col("skip") + 5, F.least(length, F.lit(2 ** 31 - 1)).cast("int")).alias("block")).filter("record_type is not null")


def _walked(spark: SparkSession, files: list[str]) -> DataFrame:
    """The records of whole files, found by their Content-Length."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if file.endswith(".gz"):
                    import gzip

                    content = gzip.decompress(content)
                at = content.find(b"WARC/1.")
                while at >= 0:
                    head = content.find(b"\r\n\r\n", at)
                    if head < 0:
                        break
                    size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", content[at:head])
                    end = head + 4 + int(size[1] if size else 0)
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([content[at + 7:end]], pa.binary())], names=["file", "value"])
                    at = content.find(b"WARC/1.", end)

    raw = spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(walk, "file string, value binary")
    return _records(F.col("value").cast("string"), raw)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record under `path`: its fields and block (RECORD_SCHEMA)."""
    lines = spark.read.option("lineSep", MARK).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    # only the first record of a file still has its mark
    records = _records(F.when(F.col("value").startswith("WARC/1."), F.expr("substring(value, 8)")).otherwise(F.col("value")), lines)
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    # one row a file at most; none for archives that this module wrote
    short = [r.file for r in records.filter(F.octet_length("block") < F.col("content_length")).select("file").distinct().collect()]
    if short:
        listed = spark.createDataFrame([(x,) for x in short], "file string")
        records = records.join(F.broadcast(listed), "file", "left_anti").unionByName(_walked(spark, short))
    return records.select(*names)


def _decode(block: bytes, keep: bool) -> tuple:
    try:
        payload = payload_of(block)
    except ValueError as e:
        return None, None, None, str(e)
    return len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload if keep else None, None


def decode_single(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Decode the records that are not segmented; segments keep their block, all others lose it (DECODED_SCHEMA)."""
    names = [x.split()[0] for x in DECODED_SCHEMA.split(", ")]
    schema = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in DECODED_SCHEMA.split(", ")])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, numbers, blocks = (batch.column(c).to_pylist() for c in ("record_type", "segment_number", "block"))
            got = [(None,) * 4 if n is not None or k == "revisit" else _decode(b, keep_payload) for k, n, b in zip(kinds, numbers, blocks)]
            own = {c: list(x) for c, x in zip(("payload_bytes", "payload_digest", "payload", "problem"), zip(*got))} if got else {}
            own["block"] = [b if n is not None else None for n, b in zip(numbers, blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(own[c], schema.field(c).type) if c in own else batch.column(c) for c in names], schema=schema)

    return records.select("record_id", "record_type", "page_id", "target_uri", "refers_to", "segment_number", "origin_id", "total_length", "block") \
        .mapInArrow(decode, DECODED_SCHEMA)


def reassemble(decoded: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One row per record of ``decode_single``'s rows that are segments: put together, verified and decoded."""
    schema = DECODED_SCHEMA

    def join(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["segment_number"], r["record_id"] or ""))
        parts = {r["segment_number"]: r for r in reversed(rows)}  # of a segment that comes twice the first counts
        head, block = parts.get(1), b"".join(parts[n]["block"] or b"" for n in sorted(parts))
        total = next((r["total_length"] for r in rows if r["total_length"] is not None), None)
        out = dict(head or rows[0], block=None, segment_number=None, origin_id=None, total_length=total)
        if head is None or sorted(parts) != list(range(1, len(parts) + 1)):
            got = None, None, None, "segments: one is missing"
        elif total != len(block):
            got = None, None, None, "segments: total length"
        else:
            got = _decode(block, keep_payload)
        out.update(zip(("payload_bytes", "payload_digest", "payload", "problem"), got))
        return pa.Table.from_pylist([out], group.schema)

    # a group is one record, which is one value in a row
    return decoded.filter("segment_number is not null").withColumn("__origin", F.coalesce("origin_id", "record_id")) \
        .groupBy("__origin").applyInArrow(lambda t: join(t.drop_columns("__origin")), schema)


def resolved(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per response and revisit under `path`: record_id, record_type, page_id, target_uri, refers_to (record),
    refers_to_page, payload_bytes, payload_digest, payload, problem; a revisit has the payload it refers to."""
    decoded = stored(decode_single(read_records(spark, path), keep_payload), "warc-decoded")
    columns = ["record_id", "record_type", "page_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload", "problem"]
    whole = decoded.filter("segment_number is null and record_type = 'response'").select(*columns) \
        .unionByName(reassemble(decoded, keep_payload).filter("record_type in ('response', 'continuation')").select(*columns))
    targets = whole.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_to_page"), "payload_bytes", "payload_digest", "payload",
                           F.col("problem").alias("theirs"), F.lit(True).alias("there"))
    revisits = decoded.filter("record_type = 'revisit'").select("record_id", "record_type", "page_id", "target_uri", "refers_to") \
        .join(targets, "refers_to", "left").withColumn("problem", F.when(F.col("there"), F.col("theirs")).otherwise("refers to no record"))
    return whole.withColumn("refers_to_page", F.lit(None).cast("long")).unionByName(revisits.drop("there", "theirs"))


def write_and_read(pages: DataFrame, path: str, **params) -> DataFrame:
    """Write the pages to `path` and give their digest as read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    write_archives(pages, path, **params)
    return resolved(pages.sparkSession, path, keep_payload=False) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


#: The same digest in DuckDB.
SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY page_id NULLS LAST, url NULLS LAST) AS k,
             first_value(page_id) OVER (PARTITION BY body ORDER BY page_id NULLS LAST, url NULLS LAST) AS f FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(
           '0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to
FROM r
"""
