"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, seek offsets.

``write_audio`` stores bytes as a mono Layer III stream: an ID3v2 tag, an info
frame with the variable-bitrate table, and protected frames whose side
information says that they hold no sound, so that their main data is free for
ancillary data. A player finds silence; nothing of the payload is lost.
``read_audio`` reads any such column, also after damage: it finds frame headers
again by their pattern and by the header that must follow, checks each frame's
CRC, and gives exact durations in samples and the offset of every frame. It
knows MPEG-1 Layer III and the Xing table, whose fields are read by their flags
and whose seek points are held against the exact offsets. MPEG-2, MPEG-2.5,
Layers I and II are skipped as junk, and a VBRI table is read as a frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocktrace.llm.common import slices, texts
from blocktrace.plans.storage import new_folder

# Fixed values of the format (MPEG-1 Layer III).
BITRATES = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
UNIT = 576
#: Header, CRC and side information of a mono frame.
HEAD, CHECK, SIDE = 4, 2, 17
DATA = HEAD + CHECK + SIDE
FRAME = 3 * BITRATES[-1]


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC of polynomial 0x8005 from 0xFFFF, as protected frames carry it."""
    value = 0xFFFF
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


@lru_cache(maxsize=32)
def frame_start(index: int) -> bytes:
    """Header, CRC and empty side information of a mono frame at 48 kHz and a bitrate index (from 1)."""
    header = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    side = bytes(SIDE)
    return header + struct.pack(">H", crc16(header[2:] + side)) + side


def payload(text: str) -> bytes:
    """UTF-8 bytes of a text, filled with 255 up to a positive multiple of the unit."""
    raw = text.encode()
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


def syncsafe(value: int) -> bytes:
    return bytes(value >> shift & 0x7F for shift in (21, 14, 7, 0))


def encode(data: bytes) -> bytes:
    """The stream that holds `data`."""
    room = FRAME - DATA
    full = len(data) // room
    blocks = np.empty((full, FRAME), dtype=np.uint8)
    blocks[:, :DATA] = np.frombuffer(frame_start(len(BITRATES)), dtype=np.uint8)
    blocks[:, DATA:] = np.frombuffer(data, dtype=np.uint8, count=full * room).reshape(full, room)
    tail = data[full * room:]
    last = b""
    if tail:
        index = next(i for i, rate in enumerate(BITRATES, 1) if 3 * rate - DATA >= len(tail))
        last = (frame_start(index) + tail).ljust(3 * BITRATES[index - 1], b"\0")
    frames = full + bool(tail)
    note = b"\0payload\0%d %d" % (len(data), zlib.crc32(data))
    body = b"TXXX" + struct.pack(">IH", len(note), 0) + note
    tag = b"ID3\x03\0\0" + syncsafe(len(body)) + body
    size = FRAME * (full + 1) + len(last)
    seconds = np.arange(100) * (frames + 1) // 100
    table = np.minimum(seconds * FRAME * 256 // size, 255).astype(np.uint8).tobytes()
    info = frame_start(len(BITRATES)) + b"Xing" + struct.pack(">III", 7, frames, size) + table
    return tag + info.ljust(FRAME, b"\0") + blocks.tobytes() + last


def header_at(data: bytes, at: int) -> tuple[int, int, bool, int] | None:
    """Frame length, sample rate, protection and side-information size, if a Layer III header stands there."""
    if at + HEAD > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xFA:
        return None
    index, rate = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if index in (0, 15) or rate == 3 or data[at + 3] & 3 == 2:
        return None
    length = 144000 * BITRATES[index - 1] // RATES[rate] + (data[at + 2] >> 1 & 1)
    return length, RATES[rate], not data[at + 1] & 1, SIDE if data[at + 3] >> 6 == 3 else 32


@dataclass
class Stream:
    """What a reader knows of a stream."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    rate: int = 0
    checked: int = 0
    failed: int = 0
    skipped: int = 0
    #: Frames and bytes as the variable-bitrate table gives them; None for what it leaves out.
    table: tuple[int | None, int | None] | None = None
    #: Its 100 seek points (256ths of the bytes), and how many of them name another place than the frames do.
    points: bytes = b""
    points_off: int = 0
    data: bytes = b""

    @property
    def samples(self) -> int:
        return SAMPLES * len(self.offsets)


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2 tag, and where it ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    size = sum((byte & 0x7F) << shift for byte, shift in zip(data[6:10], (21, 14, 7, 0)))
    end, at, found = min(10 + size, len(data)), 10, {}
    while at + 10 <= end and data[at]:
        name, length = data[at:at + 4].decode("latin-1"), int.from_bytes(data[at + 4:at + 8], "big")
        text = data[at + 11:min(at + 10 + length, end)]
        if name == "TXXX" and b"\0" in text:
            key, _, value = text.partition(b"\0")
            found[key.decode("latin-1")] = value.decode("latin-1")
        elif name.startswith("T"):
            found[name] = text.decode("latin-1").rstrip("\0")
        at += 10 + length
    return found, end


def info_table(body: bytes) -> tuple[tuple[int | None, int | None], bytes]:
    """Frames, bytes and seek points of a Xing table; its flags tell which of them it has."""
    flags, at = int.from_bytes(body[4:8], "big"), 8
    counts: list[int | None] = []
    for bit in (1, 2):
        present = flags & bit and at + 4 <= len(body)
        counts.append(int.from_bytes(body[at:at + 4], "big") if present else None)
        at += 4 * bool(flags & bit)
    return (counts[0], counts[1]), body[at:at + 100] if flags & 4 and at + 100 <= len(body) else b""


def points_off(points: bytes, starts: list[int], size: int) -> int:
    """Seek points that don't name the 256th of the bytes in which their frame starts; `starts` has the table's own first."""
    if not points or not size:
        return 0
    right = (min((starts[k * len(starts) // 100] - starts[0]) * 256 // size, 255) for k in range(100))
    return sum(a != b for a, b in zip(points, right))


def decode(data: bytes) -> Stream:
    """Read a stream; damage costs the frames it hits and no others."""
    stream = Stream()
    stream.tags, at = _tags(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" and len(data) >= 128 else len(data)
    pieces, known, first = [], False, 0
    while at < end:
        found = header_at(data, at)
        follows = found and at + found[0] <= end and (
            at + found[0] == end or (after := header_at(data, at + found[0])) and after[1] == found[1])
        if not found or at + found[0] > end or not (follows or known):
            # Resynchronise: the next place with a header that another one follows.
            place = data.find(b"\xff", at + 1, end)
            stream.skipped += (place if place > 0 else end) - at
            at, known = place if place > 0 else end, False
            continue
        known = bool(follows)
        length, rate, protected, side = found
        head = HEAD + CHECK * protected
        if protected:
            right = crc16(data[at + 2:at + 4] + data[at + head:at + head + side]) == int.from_bytes(data[at + 4:at + 6], "big")
            stream.checked += right
            stream.failed += not right
        body = at + head + side
        if not stream.offsets and stream.table is None and data[body:body + 4] in (b"Xing", b"Info"):
            stream.table, stream.points = info_table(data[body:at + length])
            first = at
        else:
            stream.offsets.append(at)
            stream.lengths.append(length)
            pieces.append(data[body:at + length])
        stream.rate = rate
        at += length
    if stream.table is not None:
        last = stream.offsets[-1] + stream.lengths[-1] if stream.offsets else at
        stream.points_off = points_off(stream.points, [first, *stream.offsets], stream.table[1] or last - first)
    stream.data = b"".join(pieces)
    size = stream.tags.get("payload", "").split()
    if len(size) == 2:
        stream.data = stream.data[:int(size[0])]
        stream.failed += zlib.crc32(stream.data) != int(size[1])
    return stream


def write_audio(docs: DataFrame, label: str = "audio") -> DataFrame:
    """Store every text as a stream: `doc_id`, `n_bytes`, `media`, in a table of the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = texts(part)
            yield pa.record_batch(
                [part.column("doc_id"), pa.array([len(t.encode()) for t in found], pa.int64()),
                 pa.array([encode(payload(t)) for t in found], pa.binary())], names=["doc_id", "n_bytes", "media"])

    media = docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")
    path = new_folder(docs.sparkSession, label)
    media.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(media.schema).parquet(path)


FEATURES = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
            "media_sha256 string, feature string, duration_samples long, sample_rate int, frames_checked long, "
            "frames_failed long, seek_offsets array<long>")


def read_audio(media: DataFrame) -> DataFrame:
    """Features of a column of streams, from the stored bytes alone.

    `media` has `doc_id`, `n_bytes` (carried along) and `media`. The duration
    is `duration_samples / sample_rate` seconds, exactly; `seek_offsets` has the
    first byte of every frame with data. Null and broken streams have no frames
    and an empty payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in FEATURES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
                 pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for part in slices(batches, "media"):
            rows = []
            for doc_id, size, data in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                stream = decode(data or b"")
                kept = stream.data
                offsets = np.array(stream.offsets, dtype="<i8")
                feature = (f"mpeg1-layer3 {stream.rate} Hz frames={len(offsets)} samples={stream.samples} "
                           f"bitrates={len(set(stream.lengths))} table={stream.table} skipped={stream.skipped} "
                           f"crc={stream.checked}/{stream.checked + stream.failed} seek={zlib.crc32(offsets.tobytes())}")
                rows.append((doc_id, size, len(kept), hashlib.sha256(kept).hexdigest(), zlib.crc32(kept[-32:]),
                             len(data or b""), hashlib.sha256(data or b"").hexdigest(), feature, stream.samples,
                             stream.rate, stream.checked, stream.failed, offsets))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def audio_features(docs: DataFrame) -> DataFrame:
    """Store every text as audio, read it back, and describe it.

    One row per row of `docs`, see ``read_audio``; `tail_crc32` covers the last
    32 bytes of the payload. Null text is empty and becomes one unit of 255s.
    Equal texts have equal values; an empty table gives no rows.
    """
    return read_audio(write_audio(docs.select("doc_id", F.col("text"))))
