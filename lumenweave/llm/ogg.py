"""Ogg media columns: bytes stored as 8-bit samples in checksummed pages.

Two logical streams are multiplexed.  The sample stream has a header packet and
packets of 576 samples; the index stream has a packet after every page of
samples with the CRC-32 of that page's samples.  Reading verifies every page's
checksum and sequence number, tells the streams apart by serial number, puts
packets together again from the lacing values, and takes timestamps from the
granule positions, which count samples.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

RATE, FRAME, PAD = 8000, 576, b"\xff"
SAMPLES, INDEX = 0x4C575350, 0x4C574958
#: Whole frames of three lacing values (255, 255, 66) that one page's 255 can hold.
FRAMES_A_PAGE = 85
_PAGE = struct.Struct("<4sBBqIIIB")
_HEADER = struct.Struct("<8sIHHQ")
CONTINUED, FIRST, LAST = 1, 2, 4
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def page_crc(page: bytes) -> int:
    """Ogg's CRC-32: polynomial 04C11DB7, most significant bit first, from 0.

    zlib's has the same polynomial with the bits of each byte and of the result mirrored.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def make_page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    page = head + lacing + body
    return page[:22] + page_crc(page).to_bytes(4, "little") + page[26:]


def lace(size: int) -> bytes:
    """A packet's lacing values: 255 as often as it goes, then the rest, 0 included."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def encode(data: bytes) -> bytes:
    """Ogg bytes of ``data``, which is padded with 255 to a positive multiple of the frame."""
    size = max(FRAME, -(-len(data) // FRAME) * FRAME)
    payload = data + PAD * (size - len(data))
    head = _HEADER.pack(b"LWPCM8\0\1", RATE, 1, FRAME, len(data))
    pages = [
        make_page(SAMPLES, 0, 0, FIRST, lace(len(head)), head),
        make_page(INDEX, 0, 0, FIRST, lace(8), b"LWINDEX\1"),
    ]
    step, frame = FRAMES_A_PAGE * FRAME, lace(FRAME)
    for number, at in enumerate(range(0, size, step), 1):
        body = payload[at : at + step]
        end = at + len(body)
        last = LAST if end == size else 0
        pages.append(make_page(SAMPLES, number, end, last, frame * (len(body) // FRAME), body))
        pages.append(make_page(INDEX, number, end, last, lace(12), struct.pack("<QI", end, zlib.crc32(body))))
    return b"".join(pages)


@dataclass
class Stream:
    """One logical stream: whole packets, and (granule, packets so far) at the end of each page."""

    packets: list[bytes] = field(default_factory=list)
    marks: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    partial: list[bytes] = field(default_factory=list)


def demultiplex(media: bytes) -> dict[int, Stream]:
    """The logical streams by serial number.  Raises OggError at the first fault."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < _PAGE.size:
            raise OggError(f"page cut short at {at}")
        capture, version, flags, granule, serial, number, crc, n = _PAGE.unpack_from(media, at)
        if capture != b"OggS" or version:
            raise OggError(f"no page at {at}")
        lacing = media[at + _PAGE.size : at + _PAGE.size + n]
        body_at = at + _PAGE.size + n
        end = body_at + sum(lacing)
        if end > len(media) or len(lacing) < n:
            raise OggError(f"page cut short at {at}")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at {at}")
        if (serial in streams) == bool(flags & FIRST):
            raise OggError(f"stream {serial:x} begins wrongly at {at}")
        stream = streams.setdefault(serial, Stream())
        if number != stream.pages or stream.ended or bool(flags & CONTINUED) != bool(stream.partial):
            raise OggError(f"page {number} of stream {serial:x} is out of order")
        start = place = body_at
        for value in lacing:
            place += value
            if value < 255:
                part = media[start:place]
                stream.packets.append(b"".join([*stream.partial, part]) if stream.partial else part)
                stream.partial, start = [], place
        if start < place:
            stream.partial.append(media[start:place])
        stream.pages, stream.ended = stream.pages + 1, bool(flags & LAST)
        if granule != -1:
            stream.marks.append((granule, len(stream.packets)))
        at = end
    if any(not s.ended or s.partial for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


def decode(media: bytes) -> tuple[bytes, int, dict]:
    """(payload, bytes before padding, features) of ``encode``'s result, all checks made."""
    streams = demultiplex(media)
    if SAMPLES not in streams or INDEX not in streams:
        raise OggError("a stream is missing")
    samples, index = streams[SAMPLES], streams[INDEX]
    magic, rate, channels, frame, n_bytes = _HEADER.unpack(samples.packets[0])
    payload = b"".join(samples.packets[1:])
    last = samples.marks[-1][0]
    if magic != b"LWPCM8\0\1" or last != len(payload) or len(payload) % frame:
        raise OggError("granule positions and samples differ")
    at = 0
    for packet in index.packets[1:]:
        end, crc = struct.unpack("<QI", packet)
        if zlib.crc32(payload[at:end]) != crc:
            raise OggError(f"samples before {end} differ from the index")
        at = end
    wave = np.frombuffer(payload, np.uint8)
    centred = wave.astype(np.float32) - 128
    crossings = int(np.count_nonzero((wave[1:] >= 128) != (wave[:-1] >= 128)))
    features = {
        "seconds": last / (rate * channels), "packets": len(samples.packets) - 1, "pages": samples.pages + index.pages,
        "page_times": [g / rate for g, _ in samples.marks], "mean": float(wave.mean()), "rms": float(np.sqrt(np.mean(centred * centred))), "crossings": crossings,
    }
    return payload, n_bytes, features


def feature_text(features: dict) -> str:
    return "seconds={seconds:.6f};packets={packets};pages={pages};mean={mean:.6f};rms={rms:.4f};crossings={crossings}".format(**features)


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most or len(held) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media: every whole text's UTF-8 bytes as an Ogg file.  A null text is empty: one frame of padding.

    One row per input row, repeated ones and null ids included; an empty table gives no rows; columns other than the two
    are not looked at, whatever their names.
    """

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])
        yield from _batches(((i, encode(text.encode())) for batch in batches for ids, texts in slices(batch) for i, text in zip(ids, texts, strict=True)), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """doc_id, media, payload, n_bytes, feature, error: what the stored bytes hold, read and verified.

    A damaged file has an error and null for what it should hold; a null one is null throughout.  One row per input
    row, in any order; an empty table gives no rows.
    """

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("n_bytes", pa.int64()), ("feature", pa.string()), ("error", pa.string())])

        def rows():
            for batch in batches:
                for i, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    stored = stored.as_py()
                    if stored is None:
                        yield i, None, None, None, None, None
                        continue
                    try:
                        payload, n_bytes, features = decode(stored)
                        yield i, stored, payload, n_bytes, feature_text(features), None
                    except (OggError, struct.error, IndexError) as why:
                        yield i, stored, None, None, None, str(why)

        yield from _batches(rows(), schema)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, media binary, payload binary, n_bytes long, feature string, error string")
