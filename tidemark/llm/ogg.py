"""Operator 9: Ogg as a media column.

`encode` stores each text's bytes as 8-bit samples in an Ogg file of two
logical streams that take turns by frame; `decode` reads such files (or any
Ogg file) back: it verifies every page's checksum, reassembles packets from
lacing values across pages, separates the logical streams by serial number and
derives timestamps from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship, textkit, worker

ship(__name__)

FRAME = 576
RATE = 8000
#: Frames of one packet at most.
PACKET_FRAMES = 8
STREAMS = 2
PAD = 255
_HEADER, _HEADER_SIZE = "<4sBBqIIIB", struct.calcsize("<4sBBqIIIB")
_IDENT, _IDENT_SIZE = "<8sBBIH", struct.calcsize("<8sBBIH")
_MAGIC = b"\x80pcm8\0\0\0"
CONTINUED, FIRST, LAST = 1, 2, 4

_BITS = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 0x04C11DB7, unreflected, zero start.  The common
    reflected CRC of the bit-reversed bytes is its mirror image."""
    mirrored = zlib.crc32(page.translate(_BITS), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_BITS), "big")


def make_page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = struct.pack(_HEADER, b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + page_checksum(page).to_bytes(4, "little") + page[26:]


def paginate(serial: int, packets: list[bytes], granules: list[int], first: int = 0) -> list[tuple[int, bytes]]:
    """Pages (granule, bytes) of one stream's packets, numbered from `first`.
    A page holds up to 255 segments; a packet may go on in the next page."""
    out, segments, chunks, closed, number, continued = [], [], [], -1, first, False

    def flush(last: bool, broken: bool) -> None:
        nonlocal segments, chunks, closed, number, continued
        kind = CONTINUED * continued | FIRST * (number == 0) | LAST * last
        out.append((closed, make_page(kind, closed, serial, number, bytes(segments), b"".join(chunks))))
        segments, chunks, closed, number, continued = [], [], -1, number + 1, broken

    for k, packet in enumerate(packets):
        lacing = [255] * (len(packet) // 255) + [len(packet) % 255]
        done = 0
        while lacing:
            take = lacing[: 255 - len(segments)]
            size = sum(take)
            segments += take
            chunks.append(packet[done : done + size])
            done, lacing = done + size, lacing[len(take) :]
            if not lacing:
                closed = granules[k]
            if len(segments) == 255 and (lacing or k + 1 < len(packets)):
                flush(False, bool(lacing))
    flush(True, False)
    return out


def encode_payload(payload: bytes) -> bytes:
    """An Ogg file of payload, whose length is a multiple of FRAME.  Stream s
    holds frames s, s + 2, ...; serial numbers come from the payload alone."""
    frames = len(payload) // FRAME
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    heads, pages = [], []
    for s in range(STREAMS):
        own = [payload[k * FRAME : (k + 1) * FRAME] for k in range(s, frames, STREAMS)]
        packets = [b"".join(own[k : k + PACKET_FRAMES]) for k in range(0, len(own), PACKET_FRAMES)]
        granules = list(np.cumsum([len(p) for p in packets]).tolist())
        heads.append(make_page(FIRST | LAST * (not packets), 0, serial + s, 0, bytes([_IDENT_SIZE]), struct.pack(_IDENT, _MAGIC, s, STREAMS, RATE, FRAME)))
        if packets:
            pages += [(g if g >= 0 else 1 << 62, k, s, page) for k, (g, page) in enumerate(paginate(serial + s, packets, granules, 1))]
    # by page number, then stream: both streams advance together
    pages.sort(key=lambda x: (x[1], x[2]))
    return b"".join(heads) + b"".join(page for *_, page in pages)


class BadMedia(ValueError):
    pass


def demultiplex(media: bytes) -> tuple[dict[int, dict], int]:
    """The logical streams of a file by serial number, and its page count.
    A stream has its packets and for each the granule position at its end
    (-1 where the page gives none).  Raises BadMedia for what doesn't hold."""
    streams: dict[int, dict] = {}
    at = pages = 0
    while at < len(media):
        if len(media) - at < _HEADER_SIZE:
            raise BadMedia("cut page header")
        magic, version, kind, granule, serial, number, checksum, count = struct.unpack_from(_HEADER, media, at)
        if magic != b"OggS" or version:
            raise BadMedia("no page where one should begin")
        lacing = media[at + _HEADER_SIZE : at + _HEADER_SIZE + count]
        end = at + _HEADER_SIZE + count + sum(lacing)
        if len(lacing) < count or end > len(media):
            raise BadMedia("cut page")
        page = media[at:end]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            raise BadMedia("page checksum")
        if kind & FIRST:
            if serial in streams:
                raise BadMedia("stream begins twice")
            streams[serial] = {"packets": [], "granules": [], "open": [], "next": 0, "ended": False}
        own = streams.get(serial)
        if own is None or own["next"] != number or own["ended"]:
            raise BadMedia("page out of order")
        if bool(kind & CONTINUED) != bool(own["open"]):
            raise BadMedia("broken continuation")
        own["next"], own["ended"] = number + 1, bool(kind & LAST)
        body = at + _HEADER_SIZE + count
        begin, size, closed = body, 0, 0
        for value in lacing:
            size += value
            if value < 255:
                own["packets"].append(b"".join([*own["open"], media[begin : begin + size]]))
                own["granules"].append(-1)
                own["open"] = []
                begin, size, closed = begin + size, 0, closed + 1
        if size:
            own["open"].append(media[begin : begin + size])
        if closed:
            own["granules"][-1] = granule
        at, pages = end, pages + 1
    if any(s["open"] or not s["ended"] for s in streams.values()):
        raise BadMedia("stream without end")
    return streams, pages


def packet_ends(sizes: list[int], granules: list[int]) -> list[int]:
    """The granule position at the end of each packet of a stream.  A page gives
    that of the last packet it closes; packets before it in the page are counted
    back by their sizes, packets after the last known position on."""
    ends = list(granules)
    for k in range(len(ends) - 2, -1, -1):
        if ends[k] < 0 <= ends[k + 1]:
            ends[k] = ends[k + 1] - sizes[k + 1]
    for k, end in enumerate(ends):
        if end < 0:
            ends[k] = (ends[k - 1] if k else 0) + sizes[k]
    return ends


def decode_payload(media: bytes) -> tuple[bytes, dict]:
    """The payload that encode_payload stored, and what was read on the way:
    counts of streams and pages, and (stream, packet, start, end) in seconds for
    every packet of samples.  Packets that leave a gap or overlap are an error."""
    streams, pages = demultiplex(media)
    tracks, times = {}, []
    for own in streams.values():
        magic, s, count, rate, frame = struct.unpack(_IDENT, own["packets"][0])
        if magic != _MAGIC or frame != FRAME or count != len(streams):
            raise BadMedia("unknown stream")
        body = own["packets"][1:]
        sizes = [len(packet) for packet in body]
        begin = 0
        for k, (size, end) in enumerate(zip(sizes, packet_ends(sizes, own["granules"][1:]))):
            if end - size != begin:
                raise BadMedia("granule position")
            times.append((s, k, begin / rate, end / rate))
            begin = end
        tracks[s] = b"".join(body)
    total = sum(map(len, tracks.values()))
    payload = np.zeros((total // FRAME, FRAME), np.uint8)
    for s, track in tracks.items():
        payload[s :: len(tracks)] = np.frombuffer(track, np.uint8).reshape(-1, FRAME)
    return payload.tobytes(), {"streams": len(streams), "pages": pages, "times": times}


def describe(payload: bytes, read: dict) -> str:
    """Features of the samples and the container, as text.  `seconds` is when
    the last packet ends, `last_start` when the last one begins."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((samples[1:] >= 0) != (samples[:-1] >= 0)))
    seconds, last = (max((t[k] for t in read["times"]), default=0.0) for k in (3, 2))
    return f"streams={read['streams']};pages={read['pages']};packets={len(read['times'])};seconds={seconds:.3f};last_start={last:.3f};mean={samples.mean():.4f};energy={int((samples * samples).sum())};crossings={crossings}"


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column and media, the Ogg file of the text's UTF-8 bytes, padded with
    bytes 255 to a positive multiple of 576.  A null text is an empty one;
    equal texts give equal files; rows that repeat give a file each; empty in,
    empty out.  A text longer than a slice is a slice of its own."""

    def kernel(data, offsets):
        raw = data.tobytes()
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            out.append(encode_payload(raw[a:b] + bytes([PAD]) * (-(b - a) % FRAME or FRAME * (a == b))))
        return [pa.array(out, pa.binary())]

    return worker.map_text(df, [id_column], text_column, "media binary", kernel)


def decode(df: DataFrame, id_column: str = "doc_id", media_column: str = "media", payload: bool = True) -> DataFrame:
    """What reading the files gives, one row each, with the payload and the
    times of its packets in seconds unless `payload` is false: then only digests
    and features leave the workers.  `status` is ok, or says what is wrong with
    the file, and the other columns are then null; a null file has the status
    `no media`.  Repeated ids are read each; empty in, empty out."""
    kind = df.schema[id_column].dataType.simpleString()
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("status", pa.string())]
    time = [("stream", pa.int32()), ("packet", pa.int32()), ("start", pa.float64()), ("end", pa.float64())]
    fields += [("payload", pa.binary()), ("times", pa.list_(pa.struct(time)))] if payload else []
    whole = payload
    no_payload = (None, None) if whole else ()

    def read(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 7 + ("no media",) + no_payload
        try:
            payload, found = decode_payload(media)
        except (BadMedia, struct.error, IndexError, ValueError) as error:
            return (None,) * 7 + (f"bad: {error}",) + no_payload
        content = (payload, [dict(zip(("stream", "packet", "start", "end"), t)) for t in found["times"]]) if whole else ()
        return len(payload.rstrip(bytes([PAD]))), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload, found), "ok", *content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(x.as_py()) for x in batch.column(1)]
            columns = zip(*rows) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, (_, t) in zip(columns, fields))], names=[id_column, *(n for n, _ in fields)])

    worker.small_batches(df.sparkSession)
    names = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(f"{n} {names.get(t, 'array<struct<stream: int, packet: int, start: double, end: double>>')}" for n, t in fields)
    return df.select(id_column, media_column).mapInArrow(run, f"`{id_column}` {kind}, {schema}")


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 holds no byte 255, so the unpadded length is read back as well."""
    return decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")), payload=False).drop("status")


QUERIES = {"op9_ogg": op9_ogg}
ORACLE: dict[str, str] = {}
