"""WARC archives: writing pages as records, reading them back, and putting segmented records together again.

A page becomes an HTTP response with chunked transfer framing. Blocks longer than ``segment_bytes`` are split: the first
segment is the response (or revisit) record itself, the others are continuation records that name it as their origin,
the last of them with the total length. Records are short, so files are bounded by a number of records, and a reader
holds one file at a time. Of pages with equal payloads the one with the largest page_id is written in full; the others
become revisit records without a payload.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from review_trust.llm.common import broadcast_if_small
from review_trust.sources.artifacts import cut, scratch_path

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 1_000
# Payloads of at least this many bytes are looked up for revisits.
REVISIT_BYTES = 0

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from five hex digits (20 bits, four characters) at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """What chunked framing holds; extensions after a chunk's size and trailer fields are skipped."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        if len(parts[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk is shorter than its size")
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response, unframed if it is sent in chunks."""
    head, _, body = block.partition(_END)
    if b"transfer-encoding: chunked" in head.lower():
        return unchunked(body)
    return body


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the two empty lines that end it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block


def page_records(
    name: str, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int
) -> Iterator[bytes]:
    """The records of one page: a response with its continuations, or a revisit."""
    target = url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None
    fields = {"WARC-Record-ID": name, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is not None:
        yield record({"WARC-Type": "revisit", **fields, "WARC-Refers-To": f"<urn:page:{refers_to}>"}, b"")
        return
    block = _HTTP + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield record({"WARC-Type": "response", **fields}, block)
        return
    yield record({"WARC-Type": "response", **fields, "WARC-Segment-Number": 1}, parts[0])
    for number, part in enumerate(parts[1:], 2):
        more = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": f"{name[:-1]}:{number}>",
            "WARC-Segment-Origin-ID": name,
            "WARC-Segment-Number": number,
            "WARC-Segment-Total-Length": len(block) if number == len(parts) else None,
        }
        yield record(more, part)


def write_archives(
    pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES
) -> None:
    """Write ``pages`` (page_id, url, html) as archives below ``path``.

    A null html is an empty payload. A null page_id is written as such and refers to the page of an equal payload with
    an id, if there is one. Every row gets a record of its own; rows that repeat the page_id and payload of a response
    are responses, too. Other columns are left out.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    counts = rows.select("digest", "page_id", F.length("payload").alias("size")).filter(F.col("size") >= revisit_bytes)
    repeated = counts.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    # 60 bytes a row.
    repeated = broadcast_if_small(cut(repeated.drop("n"), "repeated-payloads"))
    other = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.join(repeated, "digest", "left").select(
        F.concat(
            F.lit("<urn:page:"),
            F.coalesce(F.col("page_id").cast("string"), F.lit("")),
            F.lit(":"),
            F.monotonically_increasing_id(),
            F.lit(">"),
        ).alias("name"),
        "url",
        "digest",
        F.when(other, F.col("first_id")).alias("refers_to"),
        F.when(~other | F.col("first_id").isNull(), F.col("payload")).alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[bytes] = []
            for name, url, digest, refers_to, body in zip(*[c.to_pylist() for c in batch.columns]):
                made += page_records(name, url, body or b"", digest, refers_to, segment_bytes)
            for i in range(0, len(made), 256):
                yield pa.RecordBatch.from_arrays([pa.array(made[i : i + 256], pa.binary())], ["record"])

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    # The separator is what ends a record; nothing else is added to the bytes.
    writer = records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: field names in lower case, and blocks of the stated length."""
    at = 0
    while at < len(content):
        end = content.index(_END, at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + len(_END)
        at = start + int(fields["content-length"])
        if content[at : at + 4] != _END:
            raise ValueError(f"record at byte {start} does not end where its length says")
        yield fields, content[start:at]
        at += 4


RECORD = (
    "name string, type string, page_id bigint, url string, digest string, refers_to bigint, origin string, "
    "number int, total bigint, block binary"
)


def _page(urn: str) -> int | None:
    """The page_id in <urn:page:ID> or <urn:page:ID:ROW>."""
    page = urn.strip("<>").split(":")[2]
    return int(page) if page else None


def read_records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """The records that are (or are not) segments of longer ones, from all archives below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("name", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("url", pa.string())]
            + [("digest", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("number", pa.int32())]
            + [("total", pa.int64()), ("block", pa.binary())]
        )
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for f, block in parse(content.as_py()):
                    if ("warc-segment-number" in f) != segmented:
                        continue
                    origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                    refers_to = f.get("warc-refers-to")
                    rows.append(
                        {
                            "name": f["warc-record-id"],
                            "type": f["warc-type"],
                            "page_id": _page(origin),
                            "url": f.get("warc-target-uri"),
                            "digest": f.get("warc-payload-digest", "").removeprefix("sha1:"),
                            "refers_to": _page(refers_to) if refers_to else None,
                            "origin": origin,
                            "number": int(f.get("warc-segment-number", 1)),
                            "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None,
                            "block": block,
                        }
                    )
                for i in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 256], schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def reassemble(segments: DataFrame) -> DataFrame:
    """Segments (see RECORD) put together by origin, in the order of their numbers: name, ..., block.

    ``block`` is null unless the numbers run from 1 without a gap and the lengths add up to the stated total. Segments
    that are there twice count once. One group holds the segments of one record.
    """
    part = F.struct("number", "block")
    grouped = segments.groupBy("origin").agg(
        F.max(F.when(F.col("number") == 1, F.col("type"))).alias("type"),
        F.max("page_id").alias("page_id"),
        F.max("url").alias("url"),
        F.max(F.when(F.col("number") == 1, F.col("digest"))).alias("digest"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_set(part)).alias("parts"),
    )
    numbers = F.transform("parts", lambda p: p["number"])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["block"]))
    whole = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (length == F.col("total"))
    # Joining text would need valid UTF-8 only if it were read as text; the bytes pass through unchanged.
    joined = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    return grouped.select(
        F.col("origin").alias("name"),
        "type",
        "page_id",
        "url",
        "digest",
        F.lit(None).cast("long").alias("refers_to"),
        F.when(whole, joined).alias("block"),
    )


def payloads(records: DataFrame) -> DataFrame:
    """Whole records with the payload of their HTTP response and whether it has the digest that the record states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, blocks = batch.column("digest").to_pylist(), batch.column("block").to_pylist()
            bodies = [http_payload(b) if b else None for b in blocks]
            verified = [
                b is not None and base64.b32encode(hashlib.sha1(b).digest()).decode() == d
                for b, d in zip(bodies, digests)
            ]
            kept = [batch.column(c) for c in ("page_id", "url", "type", "refers_to", "digest")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(bodies, pa.binary()), pa.array(verified)],
                ["page_id", "url", "record_type", "refers_to", "digest", "payload", "verified"],
            )

    schema = (
        "page_id bigint, url string, record_type string, refers_to bigint, digest string, payload binary, "
        "verified boolean"
    )
    return records.mapInArrow(run, schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit below ``path``: page_id, url, record_type, refers_to, digest, payload, verified.

    The payload is null for revisits and for records with missing segments, which are not verified either. Only
    segmented records are shuffled.
    """
    columns = ["name", "type", "page_id", "url", "digest", "refers_to", "block"]
    whole = read_records(spark, path, segmented=False).select(*columns)
    return payloads(whole.unionByName(reassemble(read_records(spark, path, segmented=True))))


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as archives and read back: per page its payload's size and digest, record type and origin.

    Size and digest of a response are those of the payload that was read; a revisit takes them from the response it
    refers to.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    read = read_archives(spark, path).select(
        "page_id",
        "record_type",
        "refers_to",
        F.col("digest").alias("stated"),
        F.length("payload").cast("long").alias("size"),
        base32_sha1(F.col("payload")).alias("digest"),
    )
    read = cut(read, "warc-records")
    # Responses are unique by page_id and payload.
    full = read.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("digest").alias("stated"), "size", "digest"
    )
    revisits = read.filter("record_type = 'revisit'").drop("size", "digest")
    revisits = revisits.join(full.distinct(), ["refers_to", "stated"], "left")
    every = read.filter("record_type <> 'revisit'").unionByName(revisits)
    renamed = [F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest")]
    return every.select("page_id", *renamed, "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
b AS (
  SELECT p.page_id, p.h, m.top, CAST(unhex(sha1(p.h)) AS BIT)::VARCHAR AS bits FROM p JOIN m ON p.h = m.h
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
    + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b
"""
