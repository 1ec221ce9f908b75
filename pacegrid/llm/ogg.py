"""Ogg media columns: pages with checksums, packets from lacing values, multiplexed streams,
timestamps from granule positions (RFC 3533).

``mux`` interleaves the packets of logical streams into pages; ``demux`` verifies every page's
checksum and sequence number, puts packets together over segment and page borders and gives
each page-ending packet its granule position. The media column holds two streams: 8-bit
samples, and an index whose packets carry the CRC-32 of each sample packet.

Defined results: a null text counts as empty; an empty text is stored as 64 zero samples;
equal texts give equal media; repeated rows each give a row; other columns are ignored; an
empty table gives an empty table. A damaged file raises ``OggError`` in ``demux``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pacegrid.llm import common

RATE = 8000
PACKET_BYTES = 4096
PAGE_SEGMENTS = 255
NO_GRANULE = -1
CONTINUED, FIRST, LAST = 1, 2, 4

HEAD = struct.Struct("<4sBBqIIIB")
SAMPLES_MAGIC, INDEX_MAGIC = b"\x80pcm8\0", b"\x80crcs\0"
SAMPLES_SERIAL, INDEX_SERIAL = 1, 2

#: Each byte with its bits reversed: Ogg's checksum takes bits from the other end.
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """CRC of polynomial 0x04C11DB7, most significant bit first, register 0 at the start and no
    final inversion, by way of zlib's CRC of the same polynomial with reversed bits."""
    register = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(REVERSED), "big")


@dataclass
class Packet:
    data: bytes
    granule: int  # position after this packet


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    ended: bool = False


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def pages_of(stream: Stream) -> list[tuple[bool, bytes]]:
    """(first page, page) of a stream; the first packet has a page of its own."""
    out: list[tuple[bool, bytes]] = []
    lacing, body, granule, carried = bytearray(), bytearray(), NO_GRANULE, False

    def flush(last: bool, carry: bool) -> None:
        nonlocal lacing, body, granule, carried
        flags = CONTINUED * carried | FIRST * (not out) | LAST * last
        out.append((not out, page(stream.serial, len(out), flags, granule, bytes(lacing), bytes(body))))
        lacing, body, granule, carried = bytearray(), bytearray(), NO_GRANULE, carry

    for k, packet in enumerate(stream.packets):
        left, at = len(packet.data), 0
        while True:
            if len(lacing) == PAGE_SEGMENTS:
                flush(False, at > 0)
            size = min(255, left)
            lacing.append(size)
            body += packet.data[at : at + size]
            at, left = at + size, left - size
            if size < 255:
                break
        granule = packet.granule
        if k == 0 or k == len(stream.packets) - 1:
            flush(k == len(stream.packets) - 1, False)
    return out


def mux(streams: list[Stream]) -> bytes:
    """All first pages, then the streams' further pages in turn."""
    queues = [pages_of(s) for s in streams]
    out = [q[0][1] for q in queues]
    for k in range(1, max(map(len, queues))):
        out += [q[k][1] for q in queues if k < len(q)]
    return b"".join(out)


def demux(data: bytes) -> dict[int, Stream]:
    streams: dict[int, Stream] = {}
    open_parts: dict[int, bytearray] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEAD.size:
            raise OggError("cut page header")
        magic, version, flags, granule, serial, number, crc, segments = HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + HEAD.size : at + HEAD.size + segments]
        start = at + HEAD.size + segments
        end = start + sum(lacing)
        if len(lacing) < segments or end > len(data):
            raise OggError("cut page")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum of page {number} of stream {serial}")
        if bool(flags & FIRST) != (serial not in streams):
            raise OggError(f"stream {serial} doesn't begin once")
        stream = streams.setdefault(serial, Stream(serial))
        if number != stream.pages or stream.ended:
            raise OggError(f"page {number} of stream {serial} is out of sequence")
        part = open_parts.pop(serial, None)
        if bool(flags & CONTINUED) != (part is not None):
            raise OggError(f"broken packet in stream {serial}")
        part, done = part if part is not None else bytearray(), []
        started = bool(flags & CONTINUED)
        for size in lacing:
            part += data[start : start + size]
            start, started = start + size, True
            if size < 255:
                done.append(bytes(part))
                part, started = bytearray(), False
        if started:
            open_parts[serial] = part
        stream.packets += [Packet(d, granule if k == len(done) - 1 else NO_GRANULE) for k, d in enumerate(done)]
        stream.pages, stream.ended = stream.pages + 1, bool(flags & LAST)
        at = end
    if open_parts or not all(s.ended for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


def payload_of(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 if data else 64)


def store(payload: bytes, rate: int = RATE) -> bytes:
    samples = Stream(SAMPLES_SERIAL, [Packet(SAMPLES_MAGIC + struct.pack("<I", rate), 0)])
    index = Stream(INDEX_SERIAL, [Packet(INDEX_MAGIC + struct.pack("<I", PACKET_BYTES), 0)])
    for at in range(0, len(payload), PACKET_BYTES):
        block = payload[at : at + PACKET_BYTES]
        samples.packets.append(Packet(block, at + len(block)))
        index.packets.append(Packet(struct.pack("<I", zlib.crc32(block)), at + len(block)))
    return mux([samples, index])


def load(media: bytes) -> tuple[bytes, dict]:
    """(payload, facts): the samples, checked against the index stream; facts has the rate, the
    counts of pages and packets, the granule end and the time of each sample packet's page end."""
    streams = demux(media)
    by_magic = {s.packets[0].data[:6]: s for s in streams.values() if s.packets}
    if set(by_magic) != {SAMPLES_MAGIC, INDEX_MAGIC}:
        raise OggError("not a sample and an index stream")
    samples, index = by_magic[SAMPLES_MAGIC], by_magic[INDEX_MAGIC]
    blocks = [p.data for p in samples.packets[1:]]
    if [struct.pack("<I", zlib.crc32(b)) for b in blocks] != [p.data for p in index.packets[1:]]:
        raise OggError("the index doesn't match the samples")
    rate = struct.unpack_from("<I", samples.packets[0].data, 6)[0]
    ends = [p.granule for p in samples.packets[1:] if p.granule != NO_GRANULE]
    payload = b"".join(blocks)
    if ends[-1] != len(payload) or ends != sorted(ends):
        raise OggError("granule positions don't match the samples")
    return payload, {"rate": rate, "pages": sum(s.pages for s in streams.values()), "packets": len(blocks), "times": [e / rate for e in ends]}


def feature_of(payload: bytes, facts: dict) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    crossings = int(np.count_nonzero(np.diff(x >= 0)))
    return (
        f"rate={facts['rate']};seconds={facts['times'][-1]:.4f};pages={facts['pages']};packets={facts['packets']}"
        f";mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};peak={int(np.abs(x).max())};crossings={crossings}"
    )


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Each text stored as Ogg and read back: id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, and the media itself if ``keep_media``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(data: bytes) -> tuple:
        media = store(payload_of(data))
        payload, facts = load(media)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        row = (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(media), sha(media), feature_of(payload, facts))
        return (*row, media) if keep_media else row

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for batch in common.text_slices(batches, "text"):
            rows = [one(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names + ["media"] * keep_media)

    schema = (
        f"id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
        + ", media binary" * keep_media
    )
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return two.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op5_ogg_media(spark, sf_dir: str) -> DataFrame:
    return media_features(common.read_table(spark, sf_dir, "documents"), keep_media=False)
