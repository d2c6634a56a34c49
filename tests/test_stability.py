"""Runs compared, findings by path, scope guards, repairs and cells on small tables."""

import pytest
from pyspark.sql import functions as F

from lumenweave.operators import guards, stability


def test_values(spark):
    rows = [("same", r, 1, "5", "mean", "5.0 mm") for r in "abc"] + [("shape", r, 1, "5", "mean", raw) for r, raw in zip("abc", ("5", "5", "five"), strict=True)] + [("other", r, 1, v, "mean", "x") for r, v in zip("abc", "556", strict=True)]
    rows += [("gone", r, 1, "5", "mean", "x") for r in "ab"] + [("null", r, 1, v, "mean", "x") for r, v in zip("abc", ("5", None, "5"), strict=True)] + [("late", "a", 0, "9", "mean", "x"), *(("late", r, 1, "5", "MEAN ", "X") for r in "abc")] + [("none", r, 1, None, None, None) for r in "abc"] + [("none", "z", 1, "7", "m", "r")]
    df = spark.createDataFrame(rows, "slot string, run string, ord int, value string, statistic string, raw string")
    assert {r.slot: r.category for r in stability.value_stability(df, ["a", "b", "c"]).collect()} == {
        "same": "SAME_VALUE", "shape": "REPRESENTATION_ONLY_DIFFERENCE", "other": "DIFFERENT_VALUE", "gone": "MISSING_IN_ONE_RUN", "null": "MISSING_IN_ONE_RUN", "late": "SAME_VALUE", "none": "SAME_VALUE",
    }


def test_contracts_of_runs(spark):
    rows = [(1, "k", "SAME"), (1, "l", "SAME"), (1, "z", "DIFFERENT"), (2, "k", "SAME"), (3, "k", "DIFFERENT"), (4, "k", "SAME"), (4, "l", "NOT_AVAILABLE"), (5, "k", "SAME"), (5, "l", None), (6, "z", "SAME")]
    got = {r.g: r.drift for r in stability.contract_class(spark.createDataFrame(rows, "g int, key string, status string"), "g", ["k", "l"]).collect()}
    assert got == {1: "STOCHASTIC_LLM_DRIFT", 2: "CONTRACT_NOT_PROVABLE", 3: "RUN_CONTRACT_DRIFT", 4: "CONTRACT_NOT_PROVABLE", 5: "CONTRACT_NOT_PROVABLE", 6: "CONTRACT_NOT_PROVABLE"}


def test_layers(spark):
    names = list(stability.LAYER_DRIFT)
    rows = [(1, run, n, "x") for run in "ab" for n in names] + [(2, "a", n, "x") for n in names] + [(2, "b", n, "y" if n == "candidate_count" else "x") for n in names[:-1]] + [(3, "a", "parser_output", None), (3, "b", "parser_output", None), (4, "b", "skill_raw_output", "q")]
    found = stability.first_differences(spark.createDataFrame(rows, "g int, run string, layer string, digest string"), "g", "a")
    assert {(r.g, r.run): r.first_difference for r in found.collect()} == {(1, "b"): "NONE", (2, "b"): "candidate_count", (3, "b"): "NONE", (4, "b"): "skill_raw_output"}
    assert {r.g: r.interpretation for r in stability.drift_of(found, "g").collect()}[2] == "construction/merger or downstream variance"


@pytest.mark.parametrize("path, want", [("a.b", "whole"), ("x.a.b", "end"), ("x.leaf[3]", "leaf"), ("leaf", "leaf"), ("xleaf", None), ("x.a.b[1]", "indexed"), ("b", "early b")])
def test_findings(spark, path, want):
    findings = spark.createDataFrame([(9, "b", "late b"), (5, "b", "early b"), (1, "a.b", "whole" if path == "a.b" else "end"), (2, " leaf ", "leaf"), (3, "", "blank"), (4, "b[1]", "indexed")], "ord int, field string, finding string")
    assert stability.suffix_matches(spark.createDataFrame([(path,), (path,)], "path string"), findings).collect() == [(path, want)]


def test_scope(spark):
    one = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "k int, s string, n int")
    two = spark.createDataFrame([(1, "a", 2), (2, "B", None), (4, "d", 4)], "k int, s string, n int")
    got = sorted(map(tuple, guards.out_of_scope(one, two, ["k"], ["n"]).collect()), key=str)
    assert got == [(2, "s", "b", "B", "CHANGED"), (3, "n", "3", None, "REMOVED"), (3, "s", "c", None, "REMOVED"), (4, "n", None, "4", "ADDED"), (4, "s", None, "d", "ADDED")]
    assert guards.out_of_scope(one, one, ["k"], []).count() == 0
    assert {r.measure: r.same for r in guards.invariants(one, two, {"n": F.count("*"), "sum": F.sum("n")}).collect()} == {"n": True, "sum": False}


def test_repairs(spark):
    rows = spark.createDataFrame([(1, " Pain  VAS "), (2, "x"), (3, "both"), (4, None), (5, "VAS")], "k int, v string")
    aliases = spark.createDataFrame([("Pain VAS", "vas"), ("both", "p"), ("both", "q"), ("VAS", "VAS")], "alias string, canonical string")
    projection, audit = guards.surface_repair(rows, "k", "v", [("spaces", r"\s+", " "), ("ends", r"^ | $", "")], aliases)
    assert {r.k: r.v for r in projection.collect()} == {1: "vas", 2: "x", 3: "both", 4: None, 5: "VAS"}
    assert {r.k: (r.action, r.rules) for r in audit.collect()} == {1: ("BOUND", "spaces,ends"), 2: ("UNCHANGED", ""), 3: ("AMBIGUOUS", ""), 4: ("UNCHANGED", ""), 5: ("UNCHANGED", "")}


@pytest.mark.parametrize("cell, p, ci", [("p = 0.03", (0.03, "="), (None, None)), ("<.001", (0.001, "<"), (None, None)), ("0.2 to 0.9", (None, "NR"), (0.2, 0.9)), ("1-2", (None, "NR"), (None, None)), ("P≤1e-3 ", (0.001, "≤"), (None, None)), ("-1 TO -0.5", (None, "NR"), (-1.0, -0.5)), (None, (None, "NR"), (None, None)), ("p<0.05*", (None, "NR"), (None, None))])
def test_cells(spark, cell, p, ci):
    got = spark.createDataFrame([(cell,)], "c string").select(guards.p_cell(F.col("c")).alias("p"), guards.interval_to(F.col("c")).alias("ci")).first()
    assert (tuple(got.p), tuple(got.ci)) == (p, ci)
