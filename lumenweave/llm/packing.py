"""Bounded-space online packing of documents into fixed windows of tokens.

Each partition keeps a fixed number of open windows.  A document goes whole
where it fits best, the window whose room it leaves smallest; where none fits
and no further window may be opened, the fullest is filled with a cut of the
document and emitted.  Documents longer than a window fill whole windows first.
What stays open at a partition's end is merged: leftovers of up to ``fan_in``
windows are packed again by one task, level by level, until one task has them
all; it joins them into full windows and cuts the rest into powers of two, which
need no padding.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder, slices

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("open", pa.bool_())])


@dataclass(frozen=True)
class PackSpec:
    """``width`` bytes an id; a cut smaller than ``min_piece`` ids is not made, the window is padded instead."""

    window: int = 1024
    open_windows: int = 64
    min_piece: int = 1
    fan_in: int = 8192
    width: int = 4


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens); ``emit`` gets a list of them, a finished window's."""

    def __init__(self, spec: PackSpec, emit):
        self.spec, self.emit = spec, emit
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.windows: dict[int, list] = {}
        self.named = 0

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        size, w = self.spec.window, self.spec.width
        at = 0  # bytes of ids that have been placed
        while len(ids) - at >= size * w:
            self.emit([(doc_id, start + at // w, ids[at : at + size * w], doc_tokens)])
            at += size * w
        while n := (len(ids) - at) // w:
            best = bisect_left(self.rooms, (n, -1))
            if best < len(self.rooms):
                room, name = self.rooms.pop(best)
                self._put(name, room - n, (doc_id, start + at // w, ids[at:], doc_tokens))
                return
            if len(self.rooms) < self.spec.open_windows:
                self.named += 1
                self.windows[self.named] = []
                self._put(self.named, size - n, (doc_id, start + at // w, ids[at:], doc_tokens))
                return
            room, name = self.rooms.pop(0)
            if room >= self.spec.min_piece:
                self.windows[name].append((doc_id, start + at // w, ids[at : at + room * w], doc_tokens))
                at += room * w
            self.emit(self.windows.pop(name))

    def _put(self, name: int, room: int, piece) -> None:
        self.windows[name].append(piece)
        if room:
            insort(self.rooms, (room, name))
        else:
            self.emit(self.windows.pop(name))

    def left(self) -> list[list]:
        """The windows still open, fullest first."""
        return [self.windows[name] for _, name in self.rooms]

    def finish(self) -> None:
        """Join what is open into full windows; cut the rest into powers of two."""
        size, w = self.spec.window, self.spec.width
        pieces = [piece for window in self.left() for piece in window]
        total = sum(len(p[2]) for p in pieces) // w
        cuts = [size] * (total // size) + [1 << b for b in range(size.bit_length(), -1, -1) if total % size >> b & 1]
        at = 0
        for cut in cuts:
            window = []
            while cut:
                doc_id, start, ids, doc_tokens = pieces[at]
                n = min(cut, len(ids) // w)
                window.append((doc_id, start, ids[: n * w], doc_tokens))
                cut -= n
                if n * w == len(ids):
                    at += 1
                else:
                    pieces[at] = (doc_id, start + n, ids[n * w :], doc_tokens)
            self.emit(window)


def _packed(pieces, spec: PackSpec, level: int, last: bool):
    """Arrow batches of the rows that one task makes of its pieces."""
    rows, held = [], 0
    base, made = level << 56 | TaskContext.get().partitionId() << 32, 0

    def emit(window, still_open=False):
        nonlocal held, made
        offset = 0
        for doc_id, start, ids, doc_tokens in window:
            n = len(ids) // spec.width
            rows.append((doc_id, start, n, doc_tokens, base + made, offset, ids, still_open))
            offset, held = offset + n, held + len(ids)
        made += 1

    def batch():
        nonlocal rows, held
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
        rows, held = [], 0
        return out

    packer = Packer(spec, emit)
    for piece in pieces:
        packer.add(*piece)
        if held >= 1 << 22:
            yield batch()
    if last:
        packer.finish()
    else:
        for window in packer.left():
            emit(window, True)
    if rows:
        yield batch()


def pack(docs: DataFrame, tokenizer: str, end_id: int, spec: PackSpec = PackSpec(), keep_space: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    A null or empty text is the end id alone.  Repeated rows are packed each on
    its own; a null id stays null.  An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = int(end_id).to_bytes(4, "little")

    def first(batches):
        def pieces():
            enc = encoder(tokenizer, keep_space)
            for batch in batches:
                for ids, texts in slices(batch):
                    for doc_id, encoded in zip(ids, enc.encode(texts), strict=True):
                        yield doc_id, 0, encoded + end, len(encoded) // 4 + 1

        yield from _packed(pieces(), spec, 0, False)

    done = [materialize(slim.mapInArrow(first, SCHEMA), "packed")]
    level, fan_in = 0, max(spec.fan_in, 4 * spec.open_windows)  # each level leaves a quarter at most
    while True:
        left = done[-1].filter("open")
        windows = left.select("sequence_id").distinct().count()
        if not windows:
            break
        level, tasks = level + 1, -(-windows // fan_in)

        def merge(batches, level=level, last=tasks == 1):
            def pieces():
                for batch in batches:
                    yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

            yield from _packed(pieces(), spec, level, last)

        spread = left.repartition(1) if tasks == 1 else left.repartition(tasks, "sequence_id")
        again = spread.sortWithinPartitions("sequence_id", "offset").select("doc_id", "start", "ids", "doc_tokens").mapInArrow(merge, SCHEMA)
        done.append(materialize(again, "packed"))
    out = done[0].filter("NOT open")
    for part in done[1:]:
        out = out.unionByName(part.filter("NOT open"))
    return out.drop("open")
