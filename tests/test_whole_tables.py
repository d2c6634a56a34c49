"""Queries without SQL read their whole tables: every key is there, with the results of brute force."""

import hashlib
import math
import re
import unicodedata
from itertools import permutations

import pandas as pd

from lumenweave.operators import documents
from lumenweave.plans import QUERIES

SF = "/root/testdata/sf0.001"


def orders():
    lines = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_quantity"])
    return {k: list(zip(g.l_linenumber, g.l_quantity, strict=True)) for k, g in lines.groupby("l_orderkey")}


def test_perfect_matching_of_every_order(spark):
    got = {r.l_orderkey: r.perfect for r in QUERIES["jn13_gr05_perfect_matching"](spark, SF).collect()}
    want = orders()
    assert got.keys() == want.keys()
    for k, lines in want.items():
        near = [{j for j, (_, q) in enumerate(lines) if j != i and abs(p - q) <= 12} for i, (_, p) in enumerate(lines)]
        if len(lines) <= 6:
            assert got[k] == any(all(y in near[x] for x, y in enumerate(way)) for way in permutations(range(len(lines)))), k


def test_complete_link_of_every_order(spark):
    got = {(r.l_orderkey, r.l_linenumber): r.group for r in QUERIES["gr03_complete_link"](spark, SF).collect()}
    want = {}
    for k, lines in orders().items():
        most = {}
        for n, q in lines:
            most[n] = max(q, most.get(n, q))
        groups = []
        for n in sorted(most):
            at = next((i for i, g in enumerate(groups) if all(abs(most[n] - most[m]) <= 10 for m in g)), len(groups))
            groups[at:] = [groups[at] + [n], *groups[at + 1 :]] if at < len(groups) else [[n]]
            want[k, n] = at + 1
    assert got == want


def texts():
    return pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])


def test_markdown_of_every_document(spark):
    """Lines routed by a plain loop: page and section carried forward, written where they change."""
    want = {}
    for doc_id, text in texts().itertuples(index=False):
        marked = f"<!-- page 1 -->\n# Abstract\n{text}\n<!-- page 2 -->\n## Statistical methods\n| a | b |\n| --- | --- |\n| 1 | 2 |\n# Unknown words\nmore"
        page, section, out, shown = 1, "OTHER", [], (None, None)
        for line in marked.split("\n"):
            marker, heading = re.match(r"^<!--\s*page\s+([0-9]+)\s*-->$", line), re.match(r"^#+\s*(.+)$", line)
            if marker:
                page = int(marker[1])
            elif heading:
                letters = re.sub("[^a-z]+", " ", heading[1].lower()).strip()
                section = next((code for pattern, code in documents.SECTIONS if re.search(pattern, letters)), section)
            elif line.strip(" "):
                out += [f"<!-- page {page} -->"] * (page != shown[0]) + [f"## {section}"] * (section != shown[1]) + [line]
                shown = (page, section)
        want[doc_id] = hashlib.md5("\n".join(out).encode()).hexdigest()
    assert {r.doc_id: r.digest for r in QUERIES["sc10_sc17_markdown_round_trip"](spark, SF).collect()} == want


def test_casefold_of_every_document(spark):
    want = {d: hashlib.md5(" ".join(unicodedata.normalize("NFKC", x).casefold().split()).encode()).hexdigest() for d, x in texts().itertuples(index=False)}
    assert {r.doc_id: r.digest for r in QUERIES["st01_nfkc_casefold"](spark, SF).collect()} == want


def test_search_over_every_document(spark):
    words = {d: [w for w in re.findall("[a-z0-9]+", x.lower()) if len(w) > 1] for d, x in texts().itertuples(index=False)}
    mean, scores = sum(map(len, words.values())) / len(words), {}
    for q in ("the", "and", "ring"):
        df = sum(q in w for w in words.values())
        for d, w in words.items():
            if tf := w.count(q):
                scores[d] = scores.get(d, 0) + math.log((len(words) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
    want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10]
    got = QUERIES["tk12_search"](spark, SF).orderBy("rank").collect()
    assert [r.citation_id for r in got] == [str(d) for d, _ in want] and [r.rank for r in got] == list(range(1, 11))
    assert all(abs(r.score - s) < 1e-9 for r, (_, s) in zip(got, want, strict=True))
