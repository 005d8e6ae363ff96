"""Media columns in Ogg pages: mux texts to 8-bit samples, demux and verify.

A container here holds one or more logical streams. Each begins with a header
packet on a page of its own and goes on with packets of samples; pages carry
at most 255 lacing values, a checksum and the granule position (samples so
far). `demux` checks every page's checksum and order, joins the packets over
page borders from the lacing values, sorts them by stream and gives each one
its time from the granule positions.

Null texts count as empty; empty payloads become 64 zero bytes. Very long texts
span many pages; a row's work is linear in its own length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_blocks

#: Fixed values of the container format.
MAGIC = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
#: The header packet of a stream of unsigned 8-bit samples.
STREAM = struct.Struct("<8sHHIBB")
STREAM_MAGIC = b"PCM-U8  "
SAMPLE_RATE = 8000
BLOCK = 64
PACKET_SAMPLES = 16_384
STREAMS = (0x53460001, 0x53460002)

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class MediaError(ValueError):
    """A page or packet that doesn't hold together."""


def page_checksum(page: bytes) -> int:
    """Checksum of a page whose checksum field is zero.

    The format's CRC shifts left from zero with zlib's polynomial; over
    mirrored bytes it is zlib's register, mirrored.
    """
    register = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(MAGIC, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


@dataclass
class _Writer:
    """Pages of one logical stream, as its packets come."""

    serial: int
    sequence: int = 0
    granule: int = 0

    def page(self, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
        out = _page(flags, granule, self.serial, self.sequence, lacing, body)
        self.sequence += 1
        return out

    def packet(self, data: bytes, samples: int, last: bool, first: bool = False) -> list[bytes]:
        """The pages of one packet; a packet of n times 255 bytes ends with a lacing value of 0."""
        self.granule += samples
        lacing = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        pages, at = [], 0
        for i in range(0, len(lacing), 255):
            part = lacing[i : i + 255]
            size, ends = sum(part), i + 255 >= len(lacing)
            flags = CONTINUED * (i > 0) | FIRST * (first and i == 0) | LAST * (last and ends)
            pages.append(self.page(flags, self.granule if ends else NO_GRANULE, part, data[at : at + size]))
            at += size
        return pages


def mux(payload: bytes, rate: int = SAMPLE_RATE, packet: int = PACKET_SAMPLES) -> bytes:
    """A container of `payload`: its packets alternate between two streams."""
    writers = [_Writer(s) for s in STREAMS]
    pieces = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    lasts = {k: max((i for i in range(len(pieces)) if i % 2 == k), default=None) for k in range(2)}
    pages = []
    for k, w in enumerate(writers):
        head = STREAM.pack(STREAM_MAGIC, 1, k, rate, 8, 1)
        pages += w.packet(head, 0, last=lasts[k] is None, first=True)
    for i, piece in enumerate(pieces):
        pages += writers[i % 2].packet(piece, len(piece), last=lasts[i % 2] == i)
    return b"".join(pages)


@dataclass
class Stream:
    serial: int
    rate: int = 0
    index: int = 0
    packets: list[bytes] = field(default_factory=list)
    starts: list[float] = field(default_factory=list)
    granule: int = 0
    pages: int = 0
    ended: bool = False


def demux(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number; raises MediaError for any damage."""
    streams: dict[int, Stream] = {}
    open_parts: dict[int, list[bytes]] = {}
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise MediaError("a page is cut short")
        magic, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(media, at)
        if magic != MAGIC or version:
            raise MediaError("no page begins here")
        lacing = media[at + HEADER.size : at + HEADER.size + n]
        body_at = at + HEADER.size + n
        end = body_at + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise MediaError("a page is cut short")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise MediaError("a page's checksum differs")
        if bool(flags & FIRST) == (serial in streams):
            raise MediaError("a stream begins twice or without its first page")
        s = streams.setdefault(serial, Stream(serial))
        if s.ended or sequence != s.pages or bool(flags & CONTINUED) != (serial in open_parts):
            raise MediaError("a page is missing")
        s.pages += 1
        parts, done = open_parts.pop(serial, None), []
        start = body_at
        size = 0
        for v in lacing:
            size += v
            if v < 255:
                done.append(b"".join([*(parts or ()), media[start : start + size]]))
                parts, start, size = None, start + size, 0
        if size or (n and lacing[-1] == 255):
            open_parts[serial] = [*(parts or ()), media[start : start + size]]
        if done and granule < s.granule:
            raise MediaError("time runs backwards")
        # A page's granule position is the time at which its last whole packet ends.
        time = granule - sum(len(p) for p in done if s.rate)
        if done and time != s.granule:
            raise MediaError("a granule position doesn't fit its packets")
        for p in done:
            time = _accept(s, p, time)
        s.ended = bool(flags & LAST)
        at = end
    if open_parts or any(not s.ended for s in streams.values()):
        raise MediaError("a stream has no end")
    return streams


def _accept(s: Stream, packet: bytes, time: int) -> int:
    """Take a packet that starts at `time`, in samples; when it ends."""
    if not s.rate:
        magic, version, index, rate, bits, channels = STREAM.unpack(packet)
        if magic != STREAM_MAGIC or version != 1 or bits != 8 or channels != 1 or not rate:
            raise MediaError("unknown kind of stream")
        s.rate, s.index = rate, index
        return time
    s.starts.append(time / s.rate)
    s.granule = time + len(packet)
    s.packets.append(packet)
    return s.granule


def joined(streams: dict[int, Stream]) -> bytes:
    """The payload: packets of the streams in turn, by index."""
    order = sorted(streams.values(), key=lambda s: s.index)
    most = max((len(s.packets) for s in order), default=0)
    return b"".join(s.packets[i] for i in range(most) for s in order if i < len(s.packets))


def features(streams: dict[int, Stream], payload: bytes) -> str:
    """Streams, pages, packets, seconds and simple signal figures, as text."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int32) - 128
    seconds = max((s.granule / s.rate for s in streams.values()), default=0.0)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))) if len(x) > 1 else 0
    energy = int(np.dot(x.astype(np.int64), x))
    return (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};"
        f"seconds={seconds:.6f};last_start={max((t for s in streams.values() for t in s.starts), default=0.0):.6f};"
        f"energy={energy};crossings={crossings}"
    )


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for block in text_blocks(batches):
        out = {k: [] for k in names[1:]}
        for text in block.column("text"):
            data = (text.as_py() or "").encode()
            stored = mux(data + b"\0" * (-len(data) % BLOCK if data else BLOCK))
            streams = demux(stored)
            payload = joined(streams)
            for k, v in zip(
                names[1:],
                (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), features(streams, payload)),
                strict=True,
            ):
                out[k].append(v)
        kinds = {"long": pa.int64(), "string": pa.string()}
        arrays = [pa.array(out[n], kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", ")[1:])]
        yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), *arrays], names=names)


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text in a container, read it back and describe it."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows, SCHEMA)


def containers(docs: DataFrame) -> DataFrame:
    """doc_id and the stored bytes, for a sink."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            data = [(t.as_py() or "").encode() for t in block.column("text")]
            media = [mux(d + b"\0" * (-len(d) % BLOCK if d else BLOCK)) for d in data]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(stored, "doc_id long, media binary")


def op5_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
