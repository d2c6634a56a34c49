"""License scans: exact phrases, and notices found with bounded errors.

A notice of n characters that may have k errors is split into k + 1 pieces; by
the pigeonhole principle any occurrence has one piece unchanged.  Exact finds of
pieces give windows, in which the regex library's fuzzy matching verifies the
notice with at most k insertions, deletions or substitutions and gives its span.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ogg import _batches
from .tokens import slices

#: Phrases of the exact search and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    errors: int


NOTICES = (
    Notice("gnu general public license", "gpl", 3),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("licensed under the apache license", "apache", 3),
    Notice("released under the mit license", "mit", 3),
    Notice("permission is hereby granted free of charge to any person", "mit", 5),
    Notice("redistribution and use in source and binary forms", "bsd", 5),
    Notice("mozilla public license", "mpl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("licensed under cc by nc", "cc-by-nc", 1),
    Notice("licensed under cc by sa", "cc-by-sa", 1),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("you may not use this file except in compliance with the license", "apache", 5),
    Notice("redistributions in binary form must reproduce the above copyright notice", "bsd", 5),
    Notice("neither the name of the copyright holder nor the names of its contributors", "bsd-3-clause", 5),
    Notice("permission to use copy modify and or distribute this software for any purpose", "isc", 5),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 5),
    Notice("cc0 public domain dedication", "cc0", 2),
    Notice("boost software license", "bsl", 2),
)
#: Bytes that are no part of a word become spaces, A-Z lower case; all others stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(notice: Notice) -> list[tuple[int, bytes]]:
    """(offset, piece): the notice in errors + 1 pieces of nearly equal length."""
    data, n = notice.text.encode(), notice.errors + 1
    bounds = [len(data) * i // n for i in range(n + 1)]
    return [(a, data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: tuple[Notice, ...] = NOTICES):
        import regex

        self.phrases = [(p.split()[-1].encode(), re.compile(rb"(?<![^ ])" + b" ".join(map(re.escape, p.encode().split())) + rb"(?![^ ])"), label) for p, label in phrases.items()]
        self.notices = [(n, pieces(n), regex.compile(rb"(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(n.text.encode()), n.errors), regex.BESTMATCH)) for n in notices]

    def scan(self, text: str) -> dict:
        """n_words, places [(word, label)] of exact phrases, spans of notices, and their labels."""
        words = text.encode().translate(_FOLD).split()
        plain, places, spans = b" ".join(words), [], []
        ends: list[np.ndarray] = []

        def word_at(byte: int) -> int:
            """The number of the word that begins at a byte."""
            if not ends:
                ends.append(np.flatnonzero(np.frombuffer(plain, np.uint8) == 32))
            return int(np.searchsorted(ends[0], byte))

        for last, pattern, label in self.phrases:
            if last in plain:
                places += [(word_at(m.start()), label) for m in pattern.finditer(plain)]
        for notice, parts, pattern in self.notices:
            spans += self._near(plain, notice, parts, pattern, word_at)
        return {"n_words": len(words), "places": sorted(places), "spans": spans}

    def _near(self, plain: bytes, notice: Notice, parts, pattern, word_at) -> list[dict]:
        size, windows = len(notice.text), set()
        for offset, part in parts:
            at = plain.find(part)
            while at >= 0:
                # One more byte on either side lets the pattern see where words end.
                windows.add((max(0, at - offset - notice.errors - 1), min(len(plain), at - offset + size + notice.errors + 1)))
                at = plain.find(part, at + 1)
        # Each seed's window is short and verified on its own; of finds that overlap, the one with the fewest errors stays.
        found = {(sum(m.fuzzy_counts), m.start(), m.end()) for a, b in windows for m in pattern.finditer(plain, a, b)}
        starts, kept = [], []
        for errors, a, b in sorted(found):
            i = bisect_left(starts, a)
            if (i == 0 or kept[i - 1][1] <= a) and (i == len(starts) or b <= starts[i]):
                starts.insert(i, a)
                kept.insert(i, (a, b, errors))
        spans = []
        for a, b, errors in kept:
            first, text = word_at(a), plain[a:b]
            spans.append({"label": notice.label, "notice": notice.text, "errors": errors, "first_word": first, "last_word": first + len(text.split()) - 1, "found": text.decode(errors="replace")})
        return spans


_SPAN = pa.struct([("label", pa.string()), ("notice", pa.string()), ("errors", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("found", pa.string())])
_PLACE = pa.struct([("word", pa.int64()), ("label", pa.string())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (exact phrases), spans (notices with errors counted).

    Whole texts; a null or empty text has no words and no finds.  Repeated rows
    are scanned alike, an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(_PLACE)), ("spans", pa.list_(_SPAN))])

    def run(batches):
        scanner = Scanner()

        def rows():
            for batch in batches:
                for ids, texts in slices(batch):
                    for i, text in zip(ids, texts, strict=True):
                        got = scanner.scan(text)
                        yield i, got["n_words"], [{"word": w, "label": x} for w, x in got["places"]], got["spans"]

        yield from _batches(rows(), schema)

    struct = "array<struct<label:string,notice:string,errors:int,first_word:long,last_word:long,found:string>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, n_words long, places array<struct<word:long,label:string>>, spans {struct}")


def summary(scanned: DataFrame) -> DataFrame:
    """The counts, first and last places, labels and score of each scanned document.

    The score is 1 with an exact place, else one less the errors' share of the best notice, else 0.
    """
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base, words = F.transform("places", lambda x: x["label"]), F.transform("places", lambda x: x["word"])
    near = F.array_max(F.transform("spans", lambda x: 1.0 - x["errors"] / F.length(x["notice"])))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("spans", lambda x: x["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(near, F.lit(0.0))).alias("score"),
    )
