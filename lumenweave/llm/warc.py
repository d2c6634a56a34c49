"""WARC archives compressed with Zstandard, one frame a record.

An archive starts with a skippable frame that holds the compression dictionary;
each record after it is a Zstandard frame of its own.  Records of one payload
are written once: the one of the largest page id is the response, all others
are revisits that name it.  Reading walks the frames, decodes each with the
dictionary, and checks headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize
from .files import reading, task_file, writing
from .ogg import _batches

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_URN = re.compile(r"<urn:page:(-?\d*):(\d+)>")


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None, serial: int) -> str:
    """A record's name; a null page id is left empty."""
    return f"<urn:page:{'' if page_id is None else page_id}:{serial}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response, or with ``refers_to`` a revisit, whose block is the HTTP head alone.

    The payload has a part in the record's name, so that a repeated page id names different records; a
    revisit and its response have the same payload.
    """
    head = HTTP % len(payload)
    serial = int.from_bytes(hashlib.sha1(payload).digest()[:8])
    block = head if refers_to is not None else head + payload
    named = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", urn(page_id, serial)),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url or "about:blank")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        named += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to, serial))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The fields of a record, with every length and digest checked."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    if version != "WARC/1.1" or not gap or (missing := [x for x in REQUIRED if x not in fields]):
        raise WarcError(f"headers: {version!r} {missing if gap and version == 'WARC/1.1' else ''}")
    size = int(fields["Content-Length"])
    block, tail = rest[:size], rest[size:]
    if len(block) < size or tail != b"\r\n\r\n":
        raise WarcError("the block's length differs from its header")
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise WarcError("the block's digest differs")
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    name = _URN.fullmatch(fields["WARC-Record-ID"])
    out = {"page_id": int(name[1]) if name[1] else None, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": length, "payload": None, "refers_to": None}
    if out["record_type"] == "revisit":
        if body or fields.get("WARC-Profile") != PROFILE:
            raise WarcError("not a revisit to an identical payload")
        other = _URN.fullmatch(fields["WARC-Refers-To"])
        out["refers_to"] = int(other[1]) if other[1] else None
    elif len(body) != length or digest(body) != out["payload_digest"]:
        raise WarcError("the payload differs from its headers")
    else:
        out["payload"] = body
    return out


def frame_size(data, at: int) -> int:
    """Bytes of the Zstandard frame at ``at``, from its header and the headers of its blocks."""
    (magic,) = struct.unpack_from("<I", data, at)
    if magic != FRAME:
        raise WarcError(f"no frame at {at}")
    descriptor = data[at + 4]
    single, checksum = descriptor >> 5 & 1, descriptor >> 2 & 1
    place = at + 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + ((1 if single else 0), 2, 4, 8)[descriptor >> 6]
    while True:
        header = int.from_bytes(data[place : place + 3], "little")
        kind, size = header >> 1 & 3, header >> 3
        place += 3 + (1 if kind == 1 else size)
        if place > len(data) or kind == 3:
            raise WarcError(f"the frame at {at} is cut short")
        if header & 1:
            return place + 4 * checksum - at


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary, or no bytes where the samples are too few to train one."""
    import zstandard

    if len(samples) < 8 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def choose_responses(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to, the page whose record has the payload; null for responses.

    The largest page id of a payload is pre-aggregated by SHA-1 on rows without
    the payload; only the revisits' ids are then joined to the pages, by page id,
    so that no payload's copies meet in one task.  Rows that repeat the
    response's page id and payload are responses too; a null id is smallest.
    """
    keyed = pages.withColumn("sha", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    slim = keyed.select("page_id", "sha")
    best = slim.groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").select(F.col("sha").alias("b_sha"), "response")
    revisits = (
        slim.join(best, F.col("sha") == F.col("b_sha")).filter(~F.col("page_id").eqNullSafe(F.col("response")))
        .select(F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"), F.col("response").alias("refers_to")).distinct()
    )
    return keyed.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dictionary_bytes: int = 32768, sample_bytes: int = 4 << 20, level: int = 3) -> DataFrame:
    """Write every page into archives of the shared folder; returns path, n_records, n_bytes.

    Each archive's dictionary is trained on its first pages, up to
    ``sample_bytes`` of payload; that bounds the memory and has no part in what
    is stored.  A null html is an empty payload.  No pages: no archives.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def write(batches):
        import zstandard

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

        found, first, held = rows(), [], 0
        for row in found:
            first.append(row)
            held += len(row[2] or "")
            if held >= sample_bytes:
                break
        if not first:
            return
        records = lambda some: (make_record(i, url, (html or "").encode(), other) for i, url, html, other in some)
        dictionary = train([r[:65536] for r in records(first)], dictionary_bytes)
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True, write_content_size=True)
        path, n, size = task_file(folder, ".warc.zst"), 0, 8 + len(dictionary)
        with writing(path) as out:
            out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
            for some in (first, found):
                for record in records(some):
                    packed = press.compress(record)
                    out.write(packed)
                    n, size = n + 1, size + len(packed)
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    return materialize(choose_responses(slim).mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, chunk: int = 1 << 22) -> DataFrame:
    """One row a record: page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    Raises WarcError on a damaged archive.  Reads a bounded piece of a file at a time.
    """
    columns = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}

    def read(batches):
        import zstandard

        def frames(found, size):
            held, at, read_to = b"", 0, 8 + length
            while read_to < size or at < len(held):
                try:
                    n = frame_size(held, at)
                    if at + n > len(held):
                        raise WarcError("cut short")
                except (WarcError, struct.error, IndexError):
                    more = found.read(chunk)
                    if not more:
                        raise WarcError(f"the archive ends within a frame, after {read_to} bytes") from None
                    held, at, read_to = held[at:] + more, 0, read_to + len(more)
                    continue
                yield held[at : at + n]
                at += n

        def rows():
            nonlocal length
            for batch in batches:
                for path, n_records, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    with reading(path) as found:
                        magic, length = struct.unpack("<II", found.read(8))
                        if magic != SKIPPABLE:
                            raise WarcError(f"{path} has no dictionary frame")
                        dictionary = found.read(length)
                        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
                        n = 0
                        for frame in frames(found, size):
                            record = parse_record(opener.decompress(frame))
                            n += 1
                            yield tuple(record[c] for c in columns)
                        if n != n_records:
                            raise WarcError(f"{path} has {n} records, not {n_records}")

        length = 0
        yield from _batches(rows(), pa.schema(list(columns.items())))

    # A number that is asked for is kept: adaptive execution would put all the manifest's few rows into one task.
    return manifest.select("path", "n_records", "n_bytes").repartition(max(1, manifest.count()), "path").mapInArrow(
        read, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    )
