"""Decontamination, hard negatives and the filter audit against brute force, with their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenweave.llm import audit, negatives, winnowing

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i : i + m])].add(item)
    out = Counter()
    for doc_id, text in docs:
        w, hit, names = words_of(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    names |= windows[tuple(w[i : i + m])]
        names = sorted(str(n) for n in names if n is not None)
        out[doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()] += 1
    return out


def got_contamination(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAzZ09 \t\n-_'é日\x00\x7f\x80", max_size=80))
def test_words(text):
    assert [w.decode() for w in winnowing.words_of(text.encode())] == words_of(text)


def _contaminated_tables(spark, seed):
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["é日", "Zeta"]
    text = lambda n: " ".join(dice.choice(vocabulary) for _ in range(n))
    items = [(i, text(dice.choice([10, 11, 25, 40]))) for i in range(30)]
    items += [(30, text(3)), (31, "w1"), (32, text(9)), (33, ""), (34, None), (35, " - "), (None, text(12)), (7, items[9][1]), (36, items[9][1]), (37, items[9][1].upper())]
    docs = [(i, text(dice.choice([0, 1, 5, 9, 10, 60]))) for i in range(120)]
    for i in range(120, 220):
        w = items[dice.randrange(30)][1].split()
        a = dice.randrange(len(w))
        docs.append((i, f"{text(dice.randrange(9))} {', '.join(w[a : a + dice.choice([8, 9, 10, 11, 30])])} {text(dice.randrange(9))}"))
    docs += [(None, items[3][1]), (None, None), (5, items[4][1]), (5, items[4][1]), (300, " ".join([items[5][1]] * 400)), (301, items[9][1])]
    docs += [(400 + i, items[2][1]) for i in range(80)]
    return docs, items, spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_words int, row string"), spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, digest string")


@pytest.mark.parametrize("seed, parts, spec", [(1, 1, winnowing.WinnowSpec()), (2, 7, winnowing.WinnowSpec(max_filter_bits=1 << 15)), (3, 3, winnowing.WinnowSpec(bits_each=1, max_filter_bits=1 << 15))])
def test_contamination(spark, seed, parts, spec):
    docs, items, d, b = _contaminated_tables(spark, seed)
    assert got_contamination(winnowing.contamination(d.repartition(parts), b.repartition(parts), spec)) == brute_contamination(docs, items)


def test_contamination_of_empty_tables(spark):
    docs, _, d, b = _contaminated_tables(spark, 4)
    assert winnowing.contamination(d.limit(0), b).count() == 0
    assert got_contamination(winnowing.contamination(d, b.limit(0))) == brute_contamination(docs, [])


def test_contamination_of_edges(spark, edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    items = [(1, rows[6][1]), (2, "unicode text"), (3, "mit license")]
    assert got_contamination(winnowing.contamination(edge_docs, spark.createDataFrame(items, "item_id long, text string"))) == brute_contamination(rows, items)


def test_every_shared_span_has_a_shared_fingerprint():
    spec, dice = winnowing.WinnowSpec(), random.Random(5)
    memo = winnowing._Hashes()
    for _ in range(200):
        span = [bytes([97 + dice.randrange(4)]) for _ in range(10)]
        marks = [winnowing.fingerprints(winnowing._hashed(a + span + b, memo), 10, spec)[len(a)] for a, b in (([], []), ([b"x"] * 3, [b"y"]), ([b"q", b"r"], [b"s"] * 9))]
        assert len(set(marks)) == 1


def brute_negatives(rows, every=5, k=5, m=3):
    usable = []
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((vec_id, [math.floor(256 * x) for x in vector], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for a_id, a, a_label in usable:
        if a_id % every:
            continue
        scored = [(-dot(a, v), i, label) for i, v, label in usable if i != a_id]
        positives = sorted((s, i) for s, i, label in scored if label == a_label)[:k]
        for s, p in positives:
            fit = sorted((n, i) for n, i, label in scored if label != a_label and 50 * -s <= 100 * -n <= 95 * -s)[:m]
            for rank, (n, i) in enumerate(fit, 1):
                out[a_id, p, rank, i, -s, -n] += 1
    return out


def mined(df):
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def _vectors(seed, n=220):
    dice = random.Random(seed)
    rows = [(i, [dice.gauss(0.3, 0.4) for _ in range(8)], dice.randrange(4)) for i in range(n)]
    rows += [(n + i, [0.25] * 8, i % 3) for i in range(60)]  # one common vector: ties everywhere
    rows += [(1000, None, 1), (1005, [0.1] * 8, None), (1010, [0.1, None] * 4, 1), (1015, [float("nan")] * 8, 1), (1020, [float("inf")] * 8, 2), (None, [0.5] * 8, 1)]
    rows += [(1025, [], 1), (1030, [0.9, 0.9], 1), (1035, [0.5] * 12, 2), (1040, [-0.5] * 8, 9)]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts, spec", [(1, negatives.MiningSpec()), (5, negatives.MiningSpec(round_bytes=1500, anchor_block=7, candidate_block=32)), (64, negatives.MiningSpec(anchor_block=16))])
def test_negatives(spark, parts, spec):
    rows = _vectors(parts)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, key string, rank int").repartition(parts)
    want = brute_negatives(rows)
    assert len(want) > 200 and mined(negatives.mine(df, lambda c: c % 5 == 0, spec)) == want
    assert negatives.mine(df.limit(0), lambda c: c % 5 == 0, spec).count() == 0
    assert negatives.mine(df.filter("label = 9"), lambda c: c % 5 == 0, spec).count() == 0


def test_negatives_beyond_float64(spark):
    """Inner products past 2^53 are exact too."""
    dice = random.Random(9)
    rows = [(i, [float(dice.randrange(1 << 21, 1 << 22)) for _ in range(4)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute_negatives(rows)
    assert max(k[4] for k in want) > 1 << 53 and mined(negatives.mine(df, lambda c: c % 5 == 0)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.booleans()), max_size=40), st.integers(1, 9))
def test_first_keeps_the_first(values, step):
    found = negatives.First(2, 3)
    for a in range(0, len(values), step):
        some = values[a : a + step]
        scores, allowed = (np.array([[v[k] for v in some]] * 2) for k in (0, 1))
        found.offer(slice(0, 2), scores, np.arange(a, a + len(some)), allowed)
    r, i, s = found.kept()
    want = sorted((-v, k) for k, (v, ok) in enumerate(values) if ok)[:3]
    for row in (0, 1):
        assert [(-b, a) for a, b in zip(i[r == row].tolist(), s[r == row].tolist(), strict=True)] == want


def brute_audit(docs, labels):
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    failing = []
    for d, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failing.append((source or "", d, "".join(c for c, f in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= x <= "Z" for x in t) > 2 * len(t),
            any(x in "#$%&*|" for x in t), d is not None and least[t] < d), strict=True) if f)))
    out, by_filter = {}, Counter()
    for part in {p for p, _, _ in failing}:
        for order in map("".join, permutations("ABCDE")):
            left = [(d, f) for p, d, f in failing if p == part]
            everything = left
            for step, c in enumerate(order, 1):
                gone = [(d, f) for d, f in left if c in f]
                left = [(d, f) for d, f in left if c not in f]
                by_filter[part, c] += len(gone)
                redundant = sum(c in f for _, f in everything) - len(gone)
                out[part, order, step] = (len(left), len(gone), redundant, sum(f == c for _, f in everything), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
    return {k: (*v, by_filter[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_against_simulation(spark, edge_docs):
    dice = random.Random(3)
    rows = [(r.doc_id, r.text, r.source) for r in edge_docs.collect()]
    for i in range(100, 300):
        n = dice.choice([20, 199, 200, 260])
        text = " ".join(dice.choice(["a", "b", "c#", "D", "EF"]) if i % 3 else f"word{dice.randrange(10**6)}" for _ in range(n)) + dice.choice(["", "$", " Q" * 30])
        rows += [(i, text, dice.choice(["s1", "s2", None, ""]))] * dice.choice([1, 1, 1, 2]) + [(i + 1000, text, "s1")] * dice.choice([0, 0, 3])
    rows += [(None, rows[20][1], "s1"), (None, None, None)]
    labels = [(i, dice.choice([0, 1, None]), dice.choice([0, 1, None])) for i in range(0, 1300, 2)] + [(100, 1, 0), (100, 0, 1), (None, 1, 1), (99_999, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, source string, part string, mask int, digest int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, labels)
    assert audited(audit.audit(docs, marks)) == want
    assert len(want) == 600 * len({r[2] or "" for r in rows})
    assert audit.audit(docs.limit(0), marks).count() == 0
    assert audited(audit.audit(edge_docs, marks.limit(0))) == brute_audit([(r.doc_id, r.text, r.source) for r in edge_docs.collect()], [])
