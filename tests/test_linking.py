"""Links under constraints against all pairs, on small tables; hot keys make no pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenweave.operators import linking


def table(spark, seed, n, first):
    dice = random.Random(seed)
    pick = lambda *v: dice.choice([None, *v])
    rows = [(first + i, pick("x", "y", "z"), dice.choice([1, 2]), pick("a", "b"), pick(1, 2), pick("q")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, e string, f int, p string, q int, r string")


@pytest.mark.parametrize("seed", [1, 2])
def test_candidates_and_uniqueness(spark, seed):
    (a, da), (b, db) = table(spark, seed, 60, 0), table(spark, seed + 10, 45, 1000)
    fits = lambda x, y: x[1] is not None and x[1:3] == y[1:3] and all(u is None or v is None or u == v for u, v in zip(x[3:], y[3:], strict=True))
    left = {x[0]: [y[0] for y in b if fits(x, y)] for x in a}
    right = {y[0]: [x[0] for x in a if fits(x, y)] for y in b}
    one, two = linking.both_ways(da, db, ["e", "f"], ["p", "q", "r"])
    for got, own, other in ((one, left, right), (two, right, left)):
        want = {k: (len(v), min(v), len(v) == 1 and len(other[v[0]]) == 1) for k, v in own.items() if v}
        assert {r.id: (r.degree, r.partner, r.unique) for r in got.collect()} == want


def test_one_key_of_all_rows_makes_no_pairs(spark):
    """20,000 rows a side under one key: 4 * 10^8 pairs are compatible, and are only counted."""
    left, right = (spark.range(20_000).select((F.col("id") + k).alias("id"), F.lit("e").alias("e"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("p")) for k in (0, 100_000))
    degrees = Counter(r.degree for r in linking.candidates(left, right, ["e"], ["p"]).collect())
    third = [sum(i % 3 == k for i in range(20_000)) for k in range(3)]
    assert degrees == {20_000: third[0], third[0] + third[1]: third[1], third[0] + third[2]: third[2]}


def test_locks(spark):
    """A lock holds for its whole group; two of them block it, and its rows take no further part."""
    pred = spark.createDataFrame([(1, 1, "c", False), (2, 1, "c", False), (3, 3, "c", False), (4, 3, "c", False), (5, 5, "d", False), (6, 6, "e", True), (7, 7, "f", False), (8, 8, "f", False)], "id long, group long, concept string, blocked boolean")
    gold = spark.createDataFrame([(11, "c", False), (12, "c", False), (13, "c", False), (14, "d", False), (15, "e", False), (16, "f", False), (17, "d", True)], "id long, concept string, blocked boolean")
    locks = spark.createDataFrame([(11, 2), (12, 3), (13, 4)], "gold long, pred long")
    got = {(r.side, r.id): (r.status, r.other) for r in linking.link_groups(pred, gold, locks, ["concept"], []).collect()}
    assert got == {
        ("group", 1): ("LINKED", 11), ("group", 3): ("BLOCKED", None), ("group", 5): ("LINKED", 14), ("group", 6): ("EXTRA", None), ("group", 7): ("SPLIT", None), ("group", 8): ("SPLIT", None),
        ("reference", 11): ("LINKED", 2), ("reference", 12): ("LINKED", 3), ("reference", 13): ("LINKED", 4), ("reference", 14): ("LINKED", 5), ("reference", 15): ("MISSING", None),
        ("reference", 16): ("SPLIT", None), ("reference", 17): ("MISSING", None),
    }


def test_groups_by_hints(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    hints = spark.createDataFrame([(2, 1), (3, 2), (5, 6)], "u long, v long")
    assert {r.id: r.group for r in linking.alias_groups(rows, hints).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_results_and_reasons(spark):
    kinds = "id long, kind string, parent long, outcome long, derived boolean, timepoint int, analysis_set string, statistic_kind string, blocker string"
    gold = [(1, "a", 1, 1, False, 4, "ITT", "MEAN", None), (2, "a", 2, 1, False, 4, None, "MEAN", None), (3, "a", 3, 1, False, 4, None, None, None), (4, "a", 4, 1, True, 4, None, "MEAN", None), (5, "a", 9, 1, False, 4, None, "MEAN", None)]
    pred = [(21, "a", 1, 1, False, 4, None, "MEAN", None), (22, "a", 2, 1, False, 4, None, "MEAN", None), (23, "a", 2, 1, False, 4, "PP", "MEAN", None), (24, "a", 3, 1, False, 4, None, "SD", None),
            (25, "a", 4, 1, False, 4, None, "MEAN", None), (26, "a", None, 1, False, 4, None, "MEAN", None), (27, "a", 1, None, False, 4, None, "MEAN", None), (28, "a", 1, 1, False, 8, None, "MEAN", "HELD")]
    got = {r.id: (r.status, r.other, r.reason) for r in linking.link_results(spark.createDataFrame(gold, kinds), spark.createDataFrame(pred, kinds)).collect()}
    assert got == {
        1: ("MATCHED", 21, "UNIQUE_SAFE_RESULT_LINK"), 2: ("AMBIGUOUS", None, "MULTIPLE_SAFE_CANDIDATES"), 3: ("AMBIGUOUS", None, "STATISTIC_KIND_AMBIGUOUS"), 4: ("MISSING", None, "DERIVED_CONTRADICTION"),
        5: ("MISSING", None, "MISSING_RESULT_IN_PREDICTION"), 21: ("MATCHED", 1, "UNIQUE_SAFE_RESULT_LINK"), 22: ("AMBIGUOUS", None, "MULTIPLE_SAFE_CANDIDATES"), 23: ("AMBIGUOUS", None, "MULTIPLE_SAFE_CANDIDATES"),
        24: ("AMBIGUOUS", None, "STATISTIC_KIND_AMBIGUOUS"), 25: ("EXTRA", None, "DERIVED_CONTRADICTION"), 26: ("EXTRA", None, "MISSING_PARENT"), 27: ("EXTRA", None, "OUTCOME_AMBIGUOUS"), 28: ("EXTRA", None, "TIMEPOINT_CONTRADICTION"),
    }
