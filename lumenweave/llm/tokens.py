"""Whole-text tokenization with a public tokenizer, memoized by piece.

White space always ends a token of the two tokenizers in use, so a text's ids
are those of its pieces put together.  Pieces recur; each is encoded once a
worker.  A piece of Latin letters and closing marks, which is one or two
pre-tokens, goes straight to the tokenizer's model; all others go through its
whole chain.  Texts with white space other than space, tab, newline and carriage
return are encoded in one go, where pieces might not meet the tokenizer's own.
"""

from __future__ import annotations

import os
import re
from array import array

from .common import worker_state

#: White space that is not cut at, by any of the definitions in play; and letters whose lower case depends on context.
_ODD = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u0130\u03a3\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: With space that goes with the word after it.
_PIECES = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Where cutting before each space or newline might cut a token: white space that is not alone, tabs and the like.
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\0")
#: Latin letters, none of which is a mark or composes with another, perhaps after a newline, then closing marks: a pre-token each.
_PLAIN = re.compile(r"(\n?)( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]+)([.,!?;:]*)").fullmatch


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Encoder(dict):
    """Piece -> ids as bytes.  ``keep_space``: byte-level with spaces, or else lower case without them."""

    #: Pieces remembered before the memo starts anew; bounds a worker's memory.
    LIMIT = 600_000

    def __init__(self, path: str, keep_space: bool):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep_space = Tokenizer.from_file(path), keep_space
        self.model = self.tokenizer.model
        self.letters = "".join(byte_letters())

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        plain = _PLAIN(piece)
        if plain and (self.keep_space or piece[0] not in " \n"):
            newline, word, closing = plain.groups()
            if newline or closing:
                out = self[piece] = (self[newline] if newline else b"") + self[word] + (self[closing] if closing else b"")
                return out
            # Byte-level vocabularies write each byte of UTF-8 as a letter.
            ids = [x.id for x in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
            out = array("I", ids).tobytes()
        else:
            out = self._whole(piece)
        self[piece] = out
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self) > self.LIMIT:
            self.clear()
        get = self.__getitem__
        return [self._whole(x) if _ODD.search(x) else b"".join(map(get, self._cut(x))) for x in texts]

    def _cut(self, text: str) -> list[str]:
        if not self.keep_space:
            return text.lower().split()
        if any(run in text for run in _RUNS):
            return _PIECES.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def encoder(path: str, keep_space: bool) -> Encoder:
    """This worker's encoder; it outlives the task, and its memo with it."""
    return worker_state((path, keep_space), lambda: Encoder(path, keep_space))


def slices(batch, most_rows: int = 256, most_chars: int = 1 << 21):
    """An Arrow batch's (ids, texts) in pieces of bounded size; null texts are empty."""
    ids, texts, size = [], [], 0
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text = text.as_py() or ""
        if texts and (len(texts) >= most_rows or size + len(text) > most_chars):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts
