"""Titles against all pairs; paragraphs against plain search."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lumenweave.operators import narratives, titles


def plain(title):
    return " ".join("".join(c if c.isalnum() else " " for c in title.lower()).split())


@pytest.mark.parametrize("seed, least", [(1, 0.88), (2, 0.88), (3, 0.81)])
def test_lookup_misses_nothing(spark, seed, least):
    dice = random.Random(seed)
    words = ["trial", "of", "exercise", "for", "pain", "in", "knee", "the", "randomised", "x", "Ünïcode", "a-b"]
    title = lambda: " ".join(dice.choice(words) for _ in range(dice.choice([1, 2, 4, 8, 12])))
    catalogue = [(i, title(), f"10.1/C{i}" if i % 7 == 0 else None) for i in range(150)] + [(150, None, None), (151, " ", "10.1/c7"), (152, "x", None), (153, "ab", None)]
    wanted = []
    for i in range(80):
        t = list(dice.choice(catalogue)[1] or "")
        for _ in range(dice.choice([0, 1, 2, 3, 5])):
            at = dice.randrange(len(t) + 1)
            t[at : at + dice.choice([0, 1])] = dice.choice(["", "q", "z "])
        wanted.append((i, "".join(t), "10.1/c14" if i == 5 else "10.1/none" if i == 6 else None))
    wanted += [(90, None, None), (91, "  ", None), (92, "x", None), (93, "zzz qqq", None), (94, None, "10.1/C21")]
    schema = "id long, title string, doi string"
    got = {}
    for r in titles.lookup(spark.createDataFrame(wanted, schema), spark.createDataFrame(catalogue, schema), least).collect():
        got.setdefault(r.id, []).append((r.rank, r.key, r.score, r.error))
    for i, t, doi in wanted:
        by_doi = sorted(c for c, _, d in catalogue if doi and d and d.lower() == doi.lower())
        scored = sorted((-SequenceMatcher(None, plain(t), plain(c), autojunk=False).ratio(), k) for k, c, _ in catalogue if t and c and plain(t) and plain(c)) if t else []
        best = [(1, by_doi[0], 1.0, None)] if by_doi else [(n, k, -s, None) for n, (s, k) in enumerate([x for x in scored if -x[0] >= least][:3], 1)]
        want = best or [(1, None, None, "no title of the least score" if t and plain(t) else "no title")]
        assert sorted(got[i]) == sorted(want), (i, t)
    assert sum(len(v) > 1 for v in got.values()) > 3


def test_a_low_least_score_is_refused(spark):
    none = spark.createDataFrame([], "id long, title string, doi string")
    with pytest.raises(ValueError):
        titles.lookup(none, none, 0.8)
    assert titles.lookup(none, none).count() == 0


def test_prose_is_compared_exactly_where_it_may_be_among_the_best_only(monkeypatch):
    dice = random.Random(4)
    syllables = ["th", "an", "in", "er", "ion", "ha", "re", "ou", "st", "ent", "the ", "and ", "of ", "ü"]
    known = sorted({"".join(dice.choice(syllables) for _ in range(dice.randrange(2, 40))).strip() for _ in range(600)} | {"x", "ab"} | {f"{'inthe an' * 8}{c}" for c in "abcdefgh"})
    wanted = sorted({t[:9] + t[10:11] + t[9:10] + t[12:] for t in known[::12]} | {"x", "inthe an" * 8})
    every = {a: sorted(((SequenceMatcher(None, a, b, autojunk=False).ratio(), b) for b in known), reverse=True) for a in wanted}
    counts, columns = {}, {}
    for b in known:
        for at in range(len(b) - 1):
            counts[b[at : at + 2]] = counts.get(b[at : at + 2], 0) + 1
    columns = {f"{p}0": n for n, p in enumerate(sorted(counts, key=counts.get)[-100:])}
    calls = []

    class Counted(SequenceMatcher):
        def ratio(self):
            calls.append(1)
            return super().ratio()

    monkeypatch.setattr(titles, "SequenceMatcher", Counted)
    got = {}
    for a, b, score in titles.compared(wanted, known, [1] * len(known), columns, 0.88, 3):
        got.setdefault(a, []).append((score, b))
    for a in wanted:
        third = max(0.88, every[a][2][0])
        assert sorted(got.get(a, []), reverse=True) == [x for x in every[a] if x[0] >= third], a
    assert len(calls) < 5 * len(wanted)


def test_phrases(spark):
    rows = spark.createDataFrame([("VAS score (rest), mm", "Table 3 and Fig. 4; figure  5"), ("Pain", None), ("Mean age – years", "table12"), (None, "none")], "label string, caption string")
    got = rows.select(narratives.row_phrase(F.col("label")).alias("p"), narratives.caption_phrases(F.col("caption")).alias("c")).collect()
    assert [r.p for r in got] == ["vas rest mm", None, "age years", None]
    assert [r.c for r in got] == [["table 3", "figure  5"], None, ["table12"], []]


@pytest.mark.parametrize("bytes_at_once", [1 << 20, 40])
def test_relevant_paragraphs(spark, monkeypatch, bytes_at_once):
    monkeypatch.setattr(narratives, "PHRASE_BYTES", bytes_at_once)
    dice = random.Random(6)
    vocabulary = ["knee", "pain", "rest", "walk", "Table 2", "<b>age</b>", "|"]
    texts = [(i, i % 3, "\n\n".join(" ".join(dice.choice(vocabulary) for _ in range(dice.randrange(1, 6))) for _ in range(dice.randrange(5)))) for i in range(60)]
    texts += [(100, 0, None), (101, 1, " \n\n "), (102, 2, "word " * 4000), (103, 9, "knee pain"), (104, 0, "<table>knee pain</table>\n\n| a |"), (105, None, "knee pain")]
    phrases = [(0, "knee pain"), (0, "table 2"), (1, "rest walk"), (1, "walk walk"), (2, "age knee"), (None, "pain"), (0, None), (1, "")]
    got = {r.id: (r.narrative, r.n_relevant) for r in narratives.relevant(spark.createDataFrame(texts, "id long, study long, text string"), spark.createDataFrame(phrases, "study long, phrase string"), "study").collect()}
    for i, study, text in texts:
        ps = narratives.paragraphs(text or "")
        matched = list(dict.fromkeys(p for p in ps if any(s == study and f and f in p.lower() for s, f in phrases)))
        want = "" if not (text or "").strip() else "\n\n".join(matched) if matched else "\n\n".join(ps) if ps and len(text) <= 12_000 else narratives.NO_MATCH
        assert got[i] == (want, len(matched)), i
