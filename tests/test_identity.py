"""Vocabulary and cell functions, and identity by several dimensions, on small cases."""

import pytest
from pyspark.sql import functions as F

from lumenweave.functions import cells
from lumenweave.operators import identity


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("values, want", [((True, True), True), ((True, None), None), ((None, False), False), ((False, True), False)])
def test_three_valued(spark, values, want):
    assert value(spark, identity.three_valued(*[F.lit(v).cast("boolean") for v in values])) is want


@pytest.mark.parametrize("states, want", [(("EXACT", "COMPATIBLE"), (True, True)), (("EXACT", "UNKNOWN"), (True, False)), (("UNKNOWN", "CONTRADICTORY"), (False, False))])
def test_compatibility(spark, states, want):
    assert tuple(value(spark, identity.compatibility(*[F.lit(s) for s in states]))) == want


def test_reciprocal_needs_evidence(spark):
    fields = spark.createDataFrame([("a", ["1", "2"]), ("b", ["1"]), ("c", [])], "k string, e array<string>")
    targets = spark.createDataFrame([("1", "a"), ("2", "a"), ("9", "b")], "e string, k string")
    assert {r.k: r.grounded for r in identity.reciprocal(fields, targets, "k", "e").collect()} == {"a": True, "b": False, "c": False}


def test_complete_link_is_not_transitive(spark):
    nodes = spark.createDataFrame([(1, n) for n in "abcd"] + [(2, "a")], "s int, n string")
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "s int, a string, b string")
    got = {(r.s, r.n): r.group for r in identity.complete_link(pairs, nodes, "s", "n").collect()}
    assert got == {(1, "a"): 1, (1, "b"): 1, (1, "c"): 2, (1, "d"): 3, (2, "a"): 1}


def test_bind_all(spark):
    labels = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "z"), (3, "w"), (4, "none")], "k int, label string")
    aliases = spark.createDataFrame([("x", "A"), ("y", "A"), ("z", "B"), ("w", "A"), ("w", "B")], "label string, owner string")
    assert {r.k: r.owner for r in identity.bind_all(labels, aliases, "k", "label", "owner").collect()} == {1: "A", 2: None, 3: None, 4: None}


@pytest.mark.parametrize("f, raw, want", [
    (cells.number_shape, "1.8 (0.7)", "# (#)"), (cells.statistic, "Median (IQR)", "median"), (cells.statistic, "whatever", "other"), (cells.control_kind, "Usual care only", "usual_care"), (cells.suffix_number, "S1-A007", 7), (cells.suffix_number, "none", None),
    (cells.singleton, '["a"]', "a"), (cells.singleton, '["a", "b"]', None), (cells.singleton, "a", "a"), (cells.balanced_json, 'so: {"a": {"b": 1}} done', '{"a": {"b": 1}}'), (cells.balanced_json, "none", None),
    (cells.balanced_json, 'x {"a": "}]{", "b": ["\\"}"]} y {"c": 1}', '{"a": "}]{", "b": ["\\"}"]}'), (cells.balanced_json, "{broken", None), (cells.balanced_json, "[1, [2]] [3]", "[1, [2]]"), (cells.balanced_json, None, None),
])
def test_cells(spark, f, raw, want):
    assert value(spark, f(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("row, count, mean, want", [(["1.8 (0.7)", "2 (1)"], False, True, "mean"), (["1.8 (0.7)"], False, False, None), (["12 (30%)", "9 (22.5 %)"], True, False, "event_count"), (["1.8 (0.7)", "x"], False, True, None), ([], True, True, None)])
def test_row_kind(spark, row, count, mean, want):
    array = F.array(*[F.lit(x) for x in row]) if row else F.array().cast("array<string>")
    assert value(spark, cells.row_kind(array, F.lit(count), F.lit(mean))) == want


def test_header_score(spark):
    assert value(spark, cells.header_score(F.lit("Group mean"), F.lit(True))) == 3 + 1 + 1 + 1
    assert value(spark, cells.header_score(F.lit("Outcome, week 4 (n = 20)"), F.lit(False))) == 3 + 2
    assert value(spark, cells.header_score(F.lit("12"), F.lit(False))) == 0


@pytest.mark.parametrize("raw, want", [("n/a", ("NOT_APPLICABLE", None)), (None, ("NOT_REPORTED", None)), ("1.5", ("PRESENT", 1.5)), ("some", ("REVIEW_REQUIRED", None))])
def test_observation(spark, raw, want):
    assert tuple(value(spark, cells.observation(F.lit(raw).cast("string")))) == want
