"""Memoized encoding gives the tokenizer's own ids."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenweave.llm import queries, tokens

NAMES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]
PARTS = ["the", "Ünï", "don't", "I'll", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\xa0", " ", "é", "é", "a.", ",", "?!", "12", "x²", "ß", "ΑΣ", "İ", "日本", "\U0001f600", "%%%", "<|endoftext|>", "\0", "ﬁ", "ª", "´s", "Ω"]


@pytest.mark.parametrize("name, keep", NAMES)
@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=3)), max_size=12))
def test_same_ids(name, keep, parts):
    text = "".join(p for p in parts if not any(0xD800 <= ord(c) < 0xE000 for c in p))
    own = tokens.encoder(queries.tokenizer_path(name), keep)
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name, keep", NAMES)
def test_documents(name, keep, small_docs):
    own = tokens.Encoder(queries.tokenizer_path(name), keep)
    own.LIMIT = 500
    texts = [r.text for r in small_docs.select("text").collect()]
    got = [x for i in range(0, len(texts), 7) for x in own.encode(texts[i : i + 7])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
