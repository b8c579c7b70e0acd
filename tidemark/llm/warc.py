"""Operator 7: WARC archives, written and read back with segment reassembly.

Writing: a page is a response record, or a revisit of the first page with the
same payload.  The HTTP body goes in chunked transfer framing; a block longer
than a segment goes on in continuation records.  Spark's text writer puts the
records into gzipped archives.  Reading: archives are parsed record by record;
continuation records are grouped by the identifier of their origin, ordered by
segment number and checked against the total length; the chunked body is
decoded and checked against its digest.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship
from .saved import saved, scratch
from .spread import heavy, spread_join

ship(__name__)

#: Payloads shorter than this are never revisits.
SHORTEST_REVISIT = 100
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: Records of one archive at most.
ARCHIVE_RECORDS = 10_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def encoded(name: str) -> str:
    """A name as it stands in a header: controls, spaces and % in percent form."""
    return re.sub(r"[\x00-\x20\x7f%<>]", lambda m: f"%{ord(m[0]):02X}", name)


def chunked(payload: bytes) -> bytes:
    parts = []
    for k in range(0, len(payload), CHUNK_BYTES):
        part = payload[k : k + CHUNK_BYTES]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


class BadRecord(ValueError):
    pass


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise BadRecord("chunk size")
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            raise BadRecord("chunk size") from None
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise BadRecord("chunk end")
        parts.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(row: int, page_id: str | None, url: str | None, payload: bytes, digest: str, origin: str | None) -> list[bytes]:
    """The records of one page: a revisit if `origin` is the id of the page
    that holds its payload.  Identifiers follow from page id and payload; `row`
    tells the segments of repeated rows apart."""
    named = "" if page_id is None else encoded(page_id)
    own = f"urn:page:{named}:{digest}"
    common = [("WARC-Date", "2026-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Row", str(row))]
    if url is not None:
        common.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        common.append(("X-Page-ID", named))
    if origin is not None:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{own}:revisit>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{encoded(origin)}:{digest}>"), *common], _HTTP)]
    block = _HTTP + chunked(payload)
    parts = [block[k : k + SEGMENT_BYTES] for k in range(0, len(block), SEGMENT_BYTES)]
    head = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{own}>"), *common]
    if len(parts) == 1:
        return [record(head, block)]
    out = [record([*head, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{own}:{k}>"), ("WARC-Segment-Origin-ID", f"<{own}>"), ("WARC-Segment-Number", str(k)), ("X-Row", str(row)), *total], part))
    return out


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> None:
    """Write every row of pages to gzipped archives under path.

    Rows with equal payloads of SHORTEST_REVISIT bytes or more revisit that
    with the smallest id; null ids come last, and rows that repeat the smallest
    id are responses each.  A null page has an empty payload.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(html_column).cast("binary"), F.lit("").cast("binary")).alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.filter(F.octet_length("payload") >= SHORTEST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("one"), F.count("*").alias("n"))
    groups = saved(groups.filter("n > 1"))
    # the row number is only read where it is made, within the one job below;
    # a payload with very many copies is dealt into parts
    rows = spread_join(rows, groups.select("digest", "one"), "digest", F.col("row"), heavy(groups, "digest", "n"), "left").select("row", F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("one")), F.col("one").cast("string")).alias("origin"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for made in page_records(*row):
                    out.append(made[:-2])  # the writer's line separator is the last CRLF
                    size += len(made)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    made = rows.mapInArrow(write, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an archive."""
    chunks, held = iter(chunks), bytearray()

    def more() -> bool:
        piece = next(chunks, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        end = held.find(b"\r\n\r\n")
        if end < 0:
            if more():
                continue
            if held.strip():
                raise BadRecord("cut header")
            return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise BadRecord("no record where one should begin")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(headers["content-length"])
        while len(held) < end + 4 + size + 4:
            if not more():
                break
        if len(held) < end + 4 + size:
            raise BadRecord("cut block")
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def readable(name: str, content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive up to where it is damaged, if it is; then one
    of type `damaged` whose status says what is wrong."""
    try:
        yield from records(inflated(content))
    except (BadRecord, KeyError, ValueError, zlib.error) as error:
        yield {"warc-type": "damaged", "status": f"bad: {error}"}, b""


def inflated(content: bytes) -> Iterator[bytes]:
    """Uncompressed pieces of a file of gzip members, or of a plain file."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        member = zlib.decompressobj(31)
        data = content
        while not member.eof:
            piece = member.decompress(data, 1 << 20)
            data = member.unconsumed_tail
            if piece:
                yield piece
            elif not data and not member.eof:
                raise BadRecord("cut gzip member")
        content = member.unused_data.lstrip(b"\0")


_PARSED = "record_id string, row string, page_id string, record_type string, refers string, digest string, segment int, total bigint, block binary, payload_bytes bigint, payload_digest string, status string"


def _finish(block: bytes, digest: str | None) -> tuple[int | None, str | None, str, bytes | None]:
    """(payload bytes, digest, status, payload) of a whole HTTP block."""
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except BadRecord as error:
        return None, None, f"bad: {error}", None
    made = hashlib.sha256(payload).hexdigest()
    return len(payload), made, "ok" if digest in (None, made) else "bad: payload digest", payload


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Per page record: record_id, page_id (text), record_type, refers_record,
    refers_to, payload_bytes, payload_digest, status (`ok`, or what is wrong).

    With `payload`, the last column is what the page holds, for revisits that
    of the record they refer to (the html is its UTF-8 text).  Without it
    payloads stay in the tasks that check them.  An archive that is cut or
    broken gives the records before the damage and a row of type `damaged` with
    its path as record_id.  Records that repeat give a row each; archives
    without records, and no archives' records, give none."""

    with_payload, more = payload, ["payload"] * payload
    field = [("payload", pa.binary())] * payload

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("row", pa.string()), ("page_id", pa.string()), ("record_type", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string()), *field])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out, size = [], 0
                for h, block in readable(name, content.as_py()):
                    kind = h.get("warc-type")
                    if kind == "damaged":
                        out.append({"record_id": name, "record_type": kind, "status": h["status"]})
                        continue
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    digest = h["warc-payload-digest"].removeprefix("sha256:") if "warc-payload-digest" in h else None
                    segment = int(h["warc-segment-number"]) if "warc-segment-number" in h else None
                    row = {"record_id": h.get("warc-segment-origin-id") or h["warc-record-id"], "row": h.get("x-row"), "page_id": unquote(h["x-page-id"]) if "x-page-id" in h else None, "record_type": kind, "refers": h.get("warc-refers-to"), "digest": digest, "segment": segment, "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None}
                    if segment is not None:
                        row["block"] = block
                        size += len(block)
                    elif kind == "response":
                        row["payload_bytes"], row["payload_digest"], row["status"], body = _finish(block, digest)
                        if with_payload:
                            row["payload"] = body
                            size += len(body or b"")
                    out.append(row)
                    if len(out) >= 2000 or size > 1 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    parsed = saved(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, _PARSED + ", payload binary" * with_payload))

    # only records in segments travel with their blocks; a group is one page
    parts = parsed.filter("segment IS NOT NULL").groupBy("record_id", "row").agg(
        F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    joined = parts.select("record_id", "page_id", "digest", "total", F.col("parts.segment").alias("numbers"), F.col("parts.block").alias("blocks"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string()), *field])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                block = b"".join(row["blocks"])
                made: tuple = (None, None, "bad: segment numbers", None)
                if row["numbers"] == list(range(1, len(row["blocks"]) + 1)):
                    made = _finish(block, row["digest"]) if row["total"] == len(block) else (None, None, "bad: segment total length", None)
                out.append({"record_id": row["record_id"], "page_id": row["page_id"], "payload_bytes": made[0], "payload_digest": made[1], "status": made[2]} | {"payload": made[3] for _ in more})
            yield pa.RecordBatch.from_pylist(out, schema)

    whole = joined.mapInArrow(join, "record_id string, page_id string, payload_bytes bigint, payload_digest string, status string" + ", payload binary" * with_payload)
    columns = ["record_id", "page_id", "payload_bytes", "payload_digest", "status", *more]
    responses = parsed.filter("segment IS NULL AND record_type = 'response'").select(columns).unionByName(whole)
    revisits = parsed.filter("record_type = 'revisit'").select("record_id", "page_id", "refers", "digest")
    origin = responses.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest", F.col("status").alias("origin_status"), *more).dropDuplicates(["refers"])
    status = F.when(F.col("origin_status").isNull(), "bad: nothing to revisit").when(F.col("origin_status") != "ok", F.col("origin_status")).when(F.col("digest") != F.col("payload_digest"), "bad: payload digest").otherwise("ok")
    uses = saved(revisits.groupBy("refers").agg(F.count("*").alias("n")))
    # one record may have very many revisits
    revisits = revisits.withColumn("__salt", F.monotonically_increasing_id())
    resolved = spread_join(revisits, origin, "refers", F.col("__salt"), heavy(uses, "refers", "n"), "left").select("record_id", "page_id", F.lit("revisit").alias("record_type"), F.col("refers").alias("refers_record"), "refers_to", "payload_bytes", "payload_digest", status.alias("status"), *more)
    damaged = parsed.filter("record_type = 'damaged'").select("record_id", F.lit(None).cast("string").alias("page_id"), "record_type", *(F.lit(None).cast("string").alias(c) for c in ("refers_record", "refers_to")), "payload_bytes", "payload_digest", "status", *more)
    return damaged.unionByName(responses.select("record_id", "page_id", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_record"), F.lit(None).cast("string").alias("refers_to"), "payload_bytes", "payload_digest", "status", *more)).unionByName(resolved)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch(spark, "warc-")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    found = read_archives(spark, path, payload=False)
    # whatever the archives can't tell is a row with nulls, not a row less
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

QUERIES = {"op7_warc": op7_warc}
ORACLE = {"op7_warc": OP7_SQL}
