"""WARC archives with segmented records and chunked transfer framing.

Writing: each payload becomes an HTTP response with chunked framing inside a WARC/1.1 response record; a block over
SEGMENT_BYTES is cut into a first record and continuation records (WARC-Segment-Origin-ID, -Number, -Total-Length on
the last). A payload that a later page repeats becomes a revisit record. Spark's text writer with the record end as
line separator makes the files, so any Hadoop store can hold them.

Reading: files are parsed record by record, continuation records are grouped by origin identifier, put in order of
segment number, held against the total length, and the chunked framing is decoded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.llm.common import drop_path, new_path, read_table, stash, tidy

SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4_096
#: Records in a file at most, which bounds what a reader holds.
RECORDS_PER_FILE = 4_000
#: Rows of the table of repeated payloads up to which it is broadcast (about 60 bytes each); beyond, the join shuffles.
BROADCAST_DIGESTS = 100_000
_END = "\r\n\r\n"


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing."""
    out = []
    for at in range(0, len(payload), CHUNK_BYTES):
        part = payload[at : at + CHUNK_BYTES]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """What the framing holds, or None where it is broken; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0:
            return None
        if size == 0:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records(key: str, url: str, payload: bytes, refers_to: str | None) -> list[bytes]:
    """The WARC records of one page, each without the two line ends that close it."""
    ident = f"<urn:voxara:{key}>"
    common = f"WARC/1.1\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha1:{bare_digest(payload)}\r\n"
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload)
        head = f"{common}WARC-Type: revisit\r\nWARC-Record-ID: {ident}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:voxara:{refers_to}>\r\nContent-Length: {len(block)}\r\n\r\n"
        return [head.encode() + block]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    total, out = len(block), []
    for n, at in enumerate(range(0, total, SEGMENT_BYTES), 1):
        part = block[at : at + SEGMENT_BYTES]
        head = f"{common}WARC-Type: response\r\nWARC-Record-ID: {ident}\r\n" if n == 1 else f"WARC/1.1\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Type: continuation\r\nWARC-Record-ID: <urn:voxara:{key}:{n}>\r\nWARC-Segment-Origin-ID: {ident}\r\n"
        if total > SEGMENT_BYTES:
            head += f"WARC-Segment-Number: {n}\r\n"
            if at + SEGMENT_BYTES >= total and n > 1:
                head += f"WARC-Segment-Total-Length: {total}\r\n"
        out.append(f"{head}Content-Length: {len(part)}\r\n\r\n".encode() + part)
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; what is broken is skipped to the next version line."""
    at = data.find(b"WARC/1.")
    while at >= 0:
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0:
            return
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:])}
        size = head.get("content-length", "")
        end = head_end + 4 + int(size) if size.isdigit() else -1
        if end < 0 or data[end : end + 4] != b"\r\n\r\n":
            at = data.find(b"\r\nWARC/1.", head_end)
            at += 2 if at >= 0 else 0
            continue
        yield head, data[head_end + 4 : end]
        at = data.find(b"WARC/1.", end + 4)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_dedup: int = 0) -> None:
    """Writes a record per row to WARC files under path.

    Of rows with equal payloads of min_dedup bytes or more, those with the largest id are responses and others revisit
    it. A record's id holds the row's id and payload digest, so that a revisit names the very record it repeats. A null
    payload is an empty one, a null url is empty. Rows that repeat an id and a payload are one page more than once: their
    record ids have a number at the end. Rows with a null id are responses under the id "null" and such a number.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    keyed = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    twice = keyed.filter(F.length("payload") >= min_dedup).groupBy("digest", "id").agg(F.count("*").alias("n")).groupBy("digest")
    shared, _ = stash(twice.agg(F.max("id").alias("first"), F.sum("n").alias("n"), F.max("n").alias("same")).filter("n > 1").drop("n"), "warc-digests")
    if shared.count() <= BROADCAST_DIGESTS:
        shared = F.broadcast(shared)
    revisits = F.when((F.col("first") != F.col("id")) & (F.length("payload") >= min_dedup), F.col("first"))
    numbered = F.col("id").isNull() | (F.length("payload") < min_dedup) | (F.coalesce("same", F.lit(1)) > 1)
    typed = keyed.join(shared, "digest", "left").select("id", "url", "payload", "digest", revisits.alias("refers_to"), F.when(numbered, F.spark_partition_id()).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out: list[bytes] = []
                for id_, url, body, digest, refers, part in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    n += 1
                    out += records(f"{'null' if id_ is None else id_}:{digest}" + (f":{part}.{n}" if part is not None else ""), " ".join(url.split()), body, None if refers is None else f"{refers}:{digest}")
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    typed.mapInArrow(tidy(run), "value binary").select(F.col("value").cast("string")).write.option("lineSep", _END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


SEGMENT = "origin string, number bigint, total bigint, type string, refers_to string, url string, digest string, segmented boolean, block binary"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the WARC files under path; origin is the record a continuation belongs to, or its own id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("segmented", pa.bool_()), ("block", pa.binary())])
        for batch in batches:
            for cell in batch.column(0):
                rows: list[tuple] = []
                for head, block in parse(cell.as_buffer().to_pybytes()):
                    number, total = head.get("warc-segment-number", ""), head.get("warc-segment-total-length", "")
                    rows.append((head.get("warc-segment-origin-id") or head.get("warc-record-id", ""), int(number) if number.isdigit() else 1, int(total) if total.isdigit() else None, head.get("warc-type", ""), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-payload-digest"), bool(number) or head.get("warc-type") == "continuation", block))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(tidy(run), SEGMENT)


def reassemble(segments: DataFrame) -> DataFrame:
    """record_id, record_type, refers_to, url, payload, payload_bytes, payload_digest, complete.

    complete is false where a segment is missing or repeated, the total length differs, framing is broken or the
    payload's digest isn't the stated one; the payload is null then. Of a revisit record, payload is null too, and
    payload_bytes and payload_digest are those of the payload it stands for. A record of one segment passes as it is.
    """
    parts = F.sort_array(F.collect_list(F.struct("number", "block")))
    whole = segments.filter("segmented").groupBy("origin").agg(
        F.max(F.when(F.col("type") != "continuation", F.col("type"))).alias("type"), F.max("refers_to").alias("refers_to"), F.max("url").alias("url"), F.max("digest").alias("digest"), F.max("total").alias("total"),
        F.count("*").alias("n"), F.max("number").alias("last"), parts.alias("parts"),
    )
    # A record of one segment has nothing to wait for, so its block isn't shuffled.
    alone = segments.filter("not segmented").select("origin", "type", "refers_to", "url", "digest", "total", F.lit(1).cast("bigint").alias("n"), F.col("number").alias("last"), F.array(F.struct("number", "block")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "refers_to", "url", "payload", "payload_bytes", "payload_digest", "complete"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for origin, type_, refers, url, digest, total, n, last, parts in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    block = b"".join([p["block"] for p in parts])
                    good = [p["number"] for p in parts] == list(range(1, n + 1)) and (total is None and n == 1 or total == len(block))
                    head, _, body = block.partition(b"\r\n\r\n")
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                    stated = (digest or "").rpartition(":")[2]
                    if type_ == "revisit":
                        size = fields.get(b"content-length", b"")
                        rows.append((origin, type_, refers, url, None, int(size) if size.isdigit() else None, stated, good))
                        continue
                    payload = (unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body) if good else None
                    own = None if payload is None else bare_digest(payload)
                    if good := payload is not None and own == (stated or own):
                        rows.append((origin, type_, refers, url, payload, len(payload), own, True))
                    else:
                        rows.append((origin, type_, refers, url, None, None, stated, False))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return whole.select(*alone.columns).union(alone).mapInArrow(tidy(run), "record_id string, record_type string, refers_to string, url string, payload binary, payload_bytes bigint, payload_digest string, complete boolean")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as read back from their archive, which is removed again. Null html is an empty payload; see write_warc for ids."""
    path = new_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:voxara:(-?\d+)", 1).try_cast("bigint")
    found = reassemble(read_segments(spark, path)).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"), "complete")
    out, _ = stash(found, "pages-read")
    drop_path(spark, path)
    return out


def sql() -> str:
    """A digit of base32 holds 5 bits; 5 hex digits hold 4 of them."""
    digits = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[{i // 4 + 1}] >> {15 - i % 4 * 5}) & 31)::INT, 1)" for i in range(32))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS first FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, 1 + 5 * i::INT, 5))::BIGINT) AS v FROM h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {digits} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, true AS complete
FROM v"""
