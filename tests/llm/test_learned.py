"""Toxicity and language: automaton against brute force, held-out accuracy, edges."""

import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenweave.llm import language, queries, toxicity

LEX = toxicity.Lexicon({("idiot", False): 7.0, ("pathetic", False): 7.0, ("clown", False): 7.0, ("lowei", True): 6.0})


def osa(a, b):
    """Edit distance with transpositions of neighbours."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(["idiot", "pathetic", "clown"]), st.lists(st.tuples(st.sampled_from("isdx"), st.integers(0, 9), st.sampled_from("abciox1")), max_size=2))
def test_automaton_finds_what_is_within_one_edit(word, edits):
    for kind, at, c in edits:
        at %= len(word)
        word = {"i": word[:at] + c + word[at:], "s": word[:at] + c + word[at + 1 :], "d": word[:at] + word[at + 1 :], "x": word[:at] + word[at + 1 : at + 2] + word[at : at + 1] + word[at + 2 :]}[kind] or "a"
    near = min((osa(word, t), t) for t, stem in LEX.terms if not stem)
    found = LEX.find(word)
    if word[:5] == "lowei":
        return
    assert (found is not None) == (near[0] <= 1)
    if found:
        assert found == ((near[1], False), near[0] == 0)


def test_hits_and_context():
    n, found = toxicity.hits("You idoit, you absolute CLOWN! loweischaft", LEX)
    assert n == 6 and [(h[1][0], h[2]) for h in found] == [("idiot", False), ("clown", True), ("lowei", True)]
    assert not any(h[3] for h in found)
    model = toxicity.Model(LEX, toxicity.PRIOR)
    abuse, quoted, clean = (model.score(t)[0] for t in ("you are an idiot and a clown", 'he said "you are an idiot and a clown" to them', "a kind and quiet text"))
    assert clean < 0.1 < 0.7 < abuse and quoted < 0.7


def accuracy(df, truth, column):
    return df.join(truth, "doc_id").groupBy(F.lit(1)).agg(F.avg((F.col(column) == F.col("truth")).cast("double"))).first()[1]


@pytest.fixture(scope="module")
def sf01():
    return "/root/testdata/sf0.01"


def test_toxicity_held_out(spark, sf01):
    out = queries.op2_toxicity(spark, sf01)
    labels = spark.read.parquet(f"{sf01}/labels.parquet").select("doc_id", F.col("toxic").alias("truth"))
    assert out.count() == spark.read.parquet(f"{sf01}/documents.parquet").count()
    assert accuracy(out.filter("held_out"), labels, "predicted") > 0.9
    assert out.filter("score IS NULL OR score < 0 OR score > 1").count() == 0


def brute_score(text, model, near):
    """The score by plain loops over all words and all terms of the learned lexicon."""
    lexicon, spec = model.lexicon, model.lexicon.spec
    raw = text.lower().split()
    bare = [w if w.isalnum() else w.strip(toxicity._STRIP) for w in raw]
    fuzzy = [t for t in lexicon.terms if toxicity._in_trie(lexicon, t)]

    def term(word):
        if (word, False) in lexicon.terms:
            return (word, False), True
        stems = sorted((t for t in lexicon.terms if t[1] and word.startswith(t[0])), key=lambda t: len(t[0]))
        if stems:
            return stems[0], True
        close = sorted((near(word, t[0]), t) for t in fuzzy if abs(len(word) - len(t[0])) < 2)
        return (close[0][1], False) if close and close[0][0] <= 1 else None

    found = [(i, *hit) for i, hit in enumerate(map(term, bare)) if hit]
    sums = dict.fromkeys(toxicity.NAMES[:4], 0.0)
    for i, t, exact in found:
        around = range(max(0, i - spec.window), min(len(raw), i + spec.window + 1))
        quoted = toxicity._between_marks(raw[max(0, i - spec.window) : i], raw[i], raw[i + 1 : i + 1 + spec.window]) or any(raw[j].strip(toxicity._STRIP) in toxicity.REPORTING for j in around)
        sums["quoted" if quoted else "exact" if exact else "fuzzy"] += lexicon.terms[t]
        sums["close"] += not quoted and any(abs(i - j) <= spec.window for j, *_ in found if j != i)
    x = [math.log1p(sums[n]) for n in toxicity.NAMES[:4]] + [math.log1p(100 * len(found) / max(1, len(raw)))]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.weights[0] + float(np.dot(model.weights[1:], x))))))


def test_toxicity_against_plain_loops(spark):
    """The registered query's scores over a whole table, each worked out again by brute force from the lexicon and weights it learned."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(docs, labels, lambda c: toxicity.id_remainder(c, 3) != 1)
    assert model.lexicon.terms
    memo = {}
    near = lambda w, t: memo.setdefault((w, t), None) or memo.__setitem__((w, t), osa(w, t)) or memo[w, t]
    want = {r.doc_id: brute_score(r.text or "", model, near) for r in docs.collect()}
    got = {r.doc_id: (r.score, r.predicted) for r in queries.op2_toxicity(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[d][0] - s) < 1e-6 for d, s in want.items())
    assert all(p == (s >= 0.7) for s, p in got.values()) and sum(p for _, p in got.values()) > 10


def test_long_abusive_text():
    """A hit's neighbours are found by search: sixteen times the hits take about sixteen times the time."""
    took = []
    for n in (5_000, 80_000):
        began = time.process_time()
        words, found = toxicity.hits("idiot word " * n, LEX)
        took.append(time.process_time() - began)
        assert words == 2 * n and len(found) == n and {h[4] for h in found[10:-10]} == {6}
    assert took[1] < 48 * took[0] + 0.5


def test_repeated_rows_teach_once(spark):
    """Where repeated rows swell the sample past twice its bound, each id is one document."""
    texts = [(i, f"you idiot {i}" if i % 4 == 0 else f"a kind word {i}") for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    spec = toxicity.ToxicSpec(max_train=120, min_gain=10.0)
    once, often = (toxicity.learn(spark.createDataFrame(texts * k, "doc_id long, text string"), labels, lambda c: F.lit(True), spec) for k in (1, 4))
    assert once.lexicon.terms == often.lexicon.terms and ("idiot", False) in {(t.rstrip(toxicity.STEM), False) for t, _ in once.lexicon.terms}
    assert np.allclose(once.weights, often.weights)


def test_toxicity_edges(spark, edge_docs):
    labels = spark.createDataFrame([(0, 1, 0), (5, 1, 1), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(edge_docs, labels, lambda c: F.lit(True))
    rows = toxicity.score(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 and r.hits == [] for r in rows)
    nothing = toxicity.learn(edge_docs.limit(0), labels.limit(0), lambda c: F.lit(True))
    assert toxicity.score(edge_docs.limit(0), nothing).count() == 0


def test_language_held_out(spark, sf01):
    out = queries.op6_language_id(spark, sf01)
    truth = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    assert accuracy(out.filter("held_out"), truth, "lang_pred") > 0.97
    assert out.count() == truth.count()


def test_language_edges(spark, edge_docs, small_docs):
    prototypes = language.learn(small_docs, language.not_held_out)
    assert set(prototypes) == {r.lang for r in small_docs.select("lang").distinct().collect()}
    rows = language.identify(edge_docs, prototypes).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has_letter) and 0 <= r.lang_score <= 1
        assert r.size is not None or r.doc_id is None
    assert {r.lang_pred for r in language.identify(edge_docs, {}).collect()} == {"und"}
    assert language.learn(edge_docs.limit(0), language.not_held_out) == {}


def test_bundle_is_the_sum_of_bound_trigrams():
    space = language.Space()
    packed, counts, letters = space.grams("Ab  ab1ab")
    assert letters
    want = np.zeros(language.DIMENSIONS)
    codes = [0, *map(ord, "ab"), 0, *map(ord, "ab"), 0, *map(ord, "ab"), 0]
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        want += np.roll(space.letter(a), 2).astype(int) * np.roll(space.letter(b), 1) * space.letter(c)
    packed, counts, _ = space.grams("Ab  ab1ab")
    assert counts.sum() == len(codes) - 2 and np.array_equal(space.bundle(packed, counts), want)


def test_toxicity_trains_on_all_of_some_thousands(spark):
    labels = spark.range(12_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    docs = labels.select("doc_id", F.lit("a text").alias("text"))
    assert toxicity.training_rows(docs, labels, lambda c: F.lit(True), toxicity.ToxicSpec()).count() == 12_000


def test_marks_are_paired():
    quoted = lambda text: [h[3] for h in toxicity.hits(text, LEX)[1]]
    assert quoted('"you idiot," they shouted') == [True]
    assert quoted('that "good" idiot has a "day"') == [False]
    assert quoted('"idiot" and clown') == [True, False]
    assert quoted('" idiot "') == [True]
    assert quoted('idiot "fine"') == [False]


def test_toxicity_with_clashing_columns(spark, sf01):
    docs, labels = spark.read.parquet(f"{sf01}/documents.parquet"), spark.read.parquet(f"{sf01}/labels.parquet")
    every = lambda c: F.lit(True)
    plain = toxicity.learn(docs, labels, every)
    clash = toxicity.learn(docs.withColumn("toxic", F.lit("x")).withColumn("label_id", F.lit("y")), labels, every)
    assert plain.lexicon.terms == clash.lexicon.terms and np.allclose(plain.weights, clash.weights)


def test_toxicity_precision_and_recall(spark, sf01):
    """A constant answer has an accuracy of 0.87: what is found must be toxic, and what is toxic found."""
    labels = spark.read.parquet(f"{sf01}/labels.parquet").select("doc_id", F.col("toxic").alias("truth"))
    rows = queries.op2_toxicity(spark, sf01).filter("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted and r.truth == 1 for r in rows)
    assert hit > 0.9 * sum(r.predicted for r in rows) and hit > 0.7 * sum(r.truth == 1 for r in rows)


def brute_language(text, prototypes):
    """Every letter's, trigram's and text's vector worked out anew."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    codes = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
    codes = [c for i, c in enumerate(codes) if c or i == 0 or codes[i - 1]]
    letter = lambda c: 2.0 * np.random.default_rng([language.SEED, c]).integers(0, 2, language.DIMENSIONS, dtype=np.int8) - 1
    total = sum(np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
    cosines = {lang: float(total @ p) / np.linalg.norm(total) for lang, p in prototypes.items()}
    best = max(sorted(cosines), key=cosines.get)
    return best, max(0.0, cosines[best])


def test_language_against_brute_force(spark, small_docs, edge_docs):
    prototypes = language.learn(small_docs, language.not_held_out)
    some = small_docs.filter("length(text) < 1500").orderBy("doc_id").limit(25).select("doc_id", "text").union(edge_docs.filter("length(text) < 1000 OR text IS NULL").select("doc_id", "text"))
    for r in language.identify(some, prototypes).collect():
        lang, score = brute_language(r.text, prototypes)
        assert r.lang_pred == lang and abs(r.lang_score - score) < 1e-4


def test_few_labels_still_rank_held_out_documents(spark):
    """The smallest tables have six toxic documents to learn from: too few for a gain that large samples reach."""
    sf = "/root/testdata/sf0.001"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    found = [(r.score, toxic[r.doc_id]) for r in queries.QUERIES["op2_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    ones, others = [s for s, t in found if t], [s for s, t in found if not t]
    assert sum((a > b) + (a == b) / 2 for a in ones for b in others) > 0.5 * len(ones) * len(others)
