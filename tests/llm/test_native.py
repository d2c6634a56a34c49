"""Quality rules and source mixing: brute force on edges and planted tables, exact bounds."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenweave.llm import mixing, quality

SPACES = r"[^\x20\x09-\x0D]+"


def brute_counts(text):
    text = text or ""
    words = re.findall(SPACES, text)
    lines = [x for x in text.split("\n") if re.search(SPACES, x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["edge_docs", "small_docs"])
def test_counts(request, spark, which):
    docs = request.getfixturevalue(which)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    want = Counter()
    for d in docs.collect():
        n = brute_counts(d.text)
        want[(d.doc_id, *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept != r.base_failed for r in got)
    assert quality.judge(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("k, n, p", [(0, 10, 0.1), (3, 200, 0.01), (40, 10_000, 0.005), (7, 9, 0.5)])
def test_binomial_tail(spark, k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_are_proven(spark):
    """5000 good documents, 10 of them with many symbols: the cutoff is the least that so few can prove; none for a small stratum."""
    spec = quality.QualitySpec(rules=("symbols",), alpha=0.02)
    rows = [("en", 0.32 if i < 10 else 0.12 if i < 400 else 0.01) for i in range(5000)] + [("de", 0.0)] * 100 + [(None, 0.0)] * 2000
    got = {(r.stratum, r.rule): r.cutoff for r in quality.cutoffs(spark.createDataFrame(rows, "stratum string, m_symbols double"), spec).collect()}
    assert got == {("en", "symbols"): 0.15, (None, "symbols"): 0.05}


def test_verdicts_follow_cutoffs(spark):
    rows = [(i, "word " * 1 + " ".join(f"w{i}x{j}" for j in range(60)) + (" #%&" * 40 if i % 10 == 0 else ""), "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    kept = quality.judge(docs, labels, quality.QualitySpec(alpha=0.02, rules=("symbols",))).filter("kept").count()
    assert kept == 2700


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, cap=2):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = budget * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > cap * sizes[s]]
        for s in over or open_:
            target[s] = cap * sizes[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over or open_)
    return target


@pytest.mark.parametrize("which", ["edge_docs", "small_docs"])
def test_mix(request, which):
    docs = request.getfixturevalue(which)
    rows = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    want = Counter()
    for d in docs.collect():
        n = len(re.findall(SPACES, d.text or ""))
        sizes[d.source] += n
        want[d.doc_id, d.source, n] += 1
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == want
    targets = brute_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r["size"] * r.copies <= 2 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    most = max(largest.values())
    assert all(abs(taken[s] - targets[s]) <= 2 * max(largest[s], most * targets[s] / max(targets.values())) for s in targets)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert Counter(rows) == Counter(mixing.mix(docs.repartition(7)).collect())


def test_mix_of_nothing_and_of_blanks(edge_docs):
    assert mixing.mix(edge_docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(edge_docs.filter("trim(text) = ''")).collect()} == {0}


def test_mix_cuts_where_one_task_would(spark):
    """The global cut, found by histograms, is that of one ordered running total."""
    docs = spark.createDataFrame([(i, "w " * (i % 37), f"s{i % 5}") for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    import hashlib

    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append((hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest(), r.doc_id, r["size"], r.target))
    copies = []
    for s, docs_of in by_source.items():
        total, cum = sum(x[2] for x in docs_of), 0
        for key, doc_id, size, target in sorted(docs_of):
            cum += size
            copies += [((e * total + cum) / target, s, key, doc_id, e, size) for e in (0, 1)]
    left, taken = 1.5 * sum(r["size"] for r in rows), Counter()
    for _, _, _, doc_id, _, size in sorted(copies):
        left -= size
        if left < 0:
            break
        taken[doc_id] += size
    assert {r.doc_id: r.taken for r in rows if r.taken} == {k: v for k, v in taken.items() if v}
