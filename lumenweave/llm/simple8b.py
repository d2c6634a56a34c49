"""Token-id files in a word-aligned Simple-8b code.

Ids stand in blocks of 128.  A block is a run of 64-bit words; a word's top four
bits select how many ids of how many bits follow, always as many as fit.
Selector 0 is an escape: the next word holds one id of more than 60 bits whole.
Selector 1 stands for a block of zeros only.  The file keeps every block's word
offset, so all words of a segment are unpacked together, selector by selector.

File: magic, then segments, then the segments' offsets, their number and magic.
Segment: numbers of documents, ids, blocks and words; CRC-32 of what follows;
document ids with a null flag, ids in each document, block offsets, words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize
from .files import reading, task_file, writing
from .tokens import encoder, slices

MAGIC = b"LWS8B01\n"
BLOCK = 128
#: Selector -> ids a word, bits an id.
PACKINGS = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
ESCAPE, ZEROS = 0, 1
_HEAD = struct.Struct("<QQQQI4x")


#: Bits of each 16-bit value.
_SHORT = np.repeat(np.arange(17, dtype=np.uint8), [1, *(1 << b for b in range(16))])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 0 for 0."""
    if not len(values) or values.max() < 1 << 16:
        return _SHORT[values.astype(np.uint16)]
    need = np.zeros(values.shape, np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        big = values >= (np.uint64(1) << np.uint64(shift))
        need += big.astype(np.uint8) * np.uint8(shift)
        values = np.where(big, values >> np.uint64(shift), values)
    return need + (values > 0)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, block offsets) of unsigned ids.  All blocks advance together, one word at a time."""
    ids = np.ascontiguousarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    length = np.full(blocks, BLOCK)
    length[-1] = len(ids) - (blocks - 1) * BLOCK
    width = BLOCK + 60
    values = np.zeros((blocks, width), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    values[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    most = _bits(values)
    choice = np.where(most[:, :BLOCK] > 60, ESCAPE, 15).astype(np.uint8)
    count = 1
    for selector in range(14, 1, -1):
        n, bits = PACKINGS[selector]
        reach = n - count
        most[:, : width - reach] = np.maximum(most[:, : width - reach], most[:, reach:])
        count = n
        choice[most[:, :BLOCK] <= bits] = selector
    zero = ~values[:, :BLOCK].any(axis=1)
    at, alive, rows, words = np.zeros(blocks, np.int64), np.arange(blocks), [], []
    counts = np.zeros(16, np.int64)
    for selector, (n, _) in PACKINGS.items():
        counts[selector] = n
    counts[ESCAPE], counts[ZEROS] = 1, BLOCK
    while len(alive):
        pos = at[alive]
        chosen = choice[alive, pos]
        chosen[zero[alive]] = ZEROS
        word = chosen.astype(np.uint64) << np.uint64(60)
        for selector in np.unique(chosen):
            if selector in PACKINGS:
                n, bits = PACKINGS[selector]
                here = np.flatnonzero(chosen == selector)
                taken = values[alive[here, None], pos[here, None] + np.arange(n)]
                word[here] |= np.bitwise_or.reduce(taken << (np.arange(n, dtype=np.uint64) * np.uint64(bits)), axis=1)
        rows.append(alive)
        words.append(word)
        raw = np.flatnonzero(chosen == ESCAPE)
        if len(raw):
            rows.append(alive[raw])
            words.append(values[alive[raw], pos[raw]])
        at[alive] += counts[chosen]
        alive = alive[at[alive] < length[alive]]
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    per_block = np.bincount(rows, minlength=blocks)
    return np.concatenate(words)[order], (np.cumsum(per_block) - per_block).astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids that ``pack`` was given."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    # A raw word follows an escape and is no selector itself; only words of escapes need a walk.
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    counts = np.zeros(16, np.int64)
    for s, (k, _) in PACKINGS.items():
        counts[s] = k
    counts[ESCAPE], counts[ZEROS] = 1, BLOCK
    took = np.where(raw, 0, counts[selector])
    ends = np.cumsum(took)
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets.astype(np.int64), len(words))))
    start = ends - took - (ends - took)[offsets.astype(np.int64)][block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, n)
    for s, (k, bits) in PACKINGS.items():
        here = np.flatnonzero((selector == s) & ~raw)
        if len(here):
            got = (words[here, None] >> (np.arange(k, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            place = start[here, None] + np.arange(k)
            inside = place < limit[here, None]
            out[place[inside]] = got[inside]
    here = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[start[here]] = words[here + 1] if len(here) else 0
    return out


def segment(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
    words, offsets = pack(ids)
    body = b"".join((
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes(),
        np.array([len(x) for x in docs], "<u8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
    ))
    return _HEAD.pack(len(docs), len(ids), len(offsets), len(words), zlib.crc32(body)) + body


def segments(found, size: int) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, ids in each, all ids) of each segment of an open file, checked."""
    found.seek(0)
    if found.read(8) != MAGIC:
        raise ValueError("not a token-id file")
    found.seek(size - 16)
    number, magic = struct.unpack("<Q8s", found.read(16))
    if magic != MAGIC:
        raise ValueError("the file is cut short")
    found.seek(size - 16 - 8 * number)
    for at in struct.unpack(f"<{number}Q", found.read(8 * number)):
        found.seek(at)
        docs, n, blocks, words, crc = _HEAD.unpack(found.read(_HEAD.size))
        body = found.read(17 * docs + 4 * blocks + 8 * words)
        if zlib.crc32(body) != crc:
            raise ValueError(f"the segment at {at} is damaged")
        null = np.frombuffer(body, "u1", docs, 8 * docs)
        doc_ids = [None if gone else int(i) for i, gone in zip(np.frombuffer(body, "<i8", docs), null, strict=True)]
        lengths = np.frombuffer(body[9 * docs : 17 * docs], "<u8").astype(np.int64)
        offsets = np.frombuffer(body[17 * docs : 17 * docs + 4 * blocks], "<u4")
        yield doc_ids, lengths, unpack(np.frombuffer(body[17 * docs + 4 * blocks :], "<u8"), offsets, n)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, keep_space: bool = False, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = 1 << 19) -> DataFrame:
    """Encode every text, write id files in ascending document order, return their manifest.

    Manifest: part, path, first ids position ``start``, n_docs, n_ids, n_bytes.
    A null or empty text is the end id alone.  Rows of one id stand in order of
    their text; a null id comes first.  No input rows: no files.  Ranges are cut
    by id and text hash, so that a repeated id does not fill one file.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-ids")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = slim.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def write(batches):
        from pyspark import TaskContext

        from numpy import append, frombuffer

        enc, out_rows = encoder(tokenizer, keep_space), None
        path, at, starts, pending, held, n_docs, n_ids = task_file(folder, ".s8b"), len(MAGIC), [], ([], []), 0, 0, 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def chained():
            yield first
            yield from batches

        with writing(path) as out:
            out.write(MAGIC)

            def flush():
                nonlocal at, pending, held
                data = segment(*pending)
                out.write(data)
                starts.append(at)
                at, pending, held = at + len(data), ([], []), 0

            for batch in chained():
                for ids, texts in slices(batch):
                    for doc_id, encoded in zip(ids, enc.encode(texts), strict=True):
                        tokens = append(frombuffer(encoded, "<u4"), np.uint32(end_id))
                        pending[0].append(doc_id)
                        pending[1].append(tokens)
                        held, n_docs, n_ids = held + len(tokens), n_docs + 1, n_ids + len(tokens)
                        if held >= segment_ids:
                            flush()
            if held:
                flush()
            out.write(struct.pack(f"<{len(starts)}Q", *starts) + struct.pack("<Q8s", len(starts), MAGIC))
        size = at + 8 * len(starts) + 16
        out_rows = {"part": [TaskContext.get().partitionId()], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [size]}
        yield pa.RecordBatch.from_pydict(out_rows, pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    written = ranged.select("doc_id", "text").mapInArrow(write, "part long, path string, n_docs long, n_ids long, n_bytes long")
    files = materialize(written, "token-manifest")
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document in the files."""

    def read(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with reading(path) as found:
                    for doc_ids, lengths, ids in segments(found, size):
                        ends = np.cumsum(lengths)
                        data = ids.astype("<u4").tobytes()
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": doc_ids, "start": start + ends - lengths, "n_tokens": lengths,
                            "ids": [data[4 * a : 4 * b] for a, b in zip(ends - lengths, ends, strict=True)],
                        }, schema)
                        start += int(ends[-1]) if len(ends) else 0

    # A number that is asked for is kept: adaptive execution would put all the manifest's few rows into one task.
    tasks = manifest.select("path", "n_bytes", "start", "part").repartition(max(1, manifest.count()), "part").drop("part")
    return tasks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
