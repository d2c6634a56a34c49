"""Contracts, traces and the summary of a benchmark on small tables."""

import re


from lumenweave.operators import contracts, merging, metrics, traces


def tables(spark):
    person = spark.createDataFrame([(1, "a", 10, [2]), (2, "b", 11, [1, 3]), (3, "c", None, []), (3, "a", 99, None), (4, "x", 10, [4])], "id long, kind string, house long, knows array<long>")
    house = spark.createDataFrame([(10, 5.0, 5.004), (11, 5.0, 6.0), (12, None, 1.0), (None, 1.0, 1.0)], "house_id long, a double, b double")
    return {"person": person, "house": house}


RULES = [
    contracts.allowed("kind", "person", "kind", "a", "b", "c"), contracts.Unique("person id", "person", ("id",)), contracts.Unique("id and kind", "person", ("id", "kind")),
    contracts.Foreign("house", "person", ("house",), "house", ("house_id",)), contracts.Check("close", "house", "abs(a - b) <= 0.01"),
    contracts.Reciprocal("knows", "person", "id", "knows", "person", "id", "knows"), contracts.Foreign("self", "person", ("id", "kind"), "person", ("id", "kind")),
]


def test_violations(spark):
    got = sorted((r.rule, r.id) for r in contracts.violations(tables(spark), {"person": "id", "house": "house_id"}, RULES).collect())
    assert got == [("close", "11"), ("house", "3"), ("kind", "4"), ("knows", "2"), ("person id", "3")]


def test_a_further_rule_adds_no_scan(spark, tmp_path):
    for name, df in tables(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
    stored = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in ("person", "house")}
    scans = lambda rules: len(re.findall("FileScan", contracts.facts(stored, {"person": "id", "house": "house_id"}, rules)._jdf.queryExecution().executedPlan().toString()))
    assert scans(RULES[:1] + RULES[3:5]) == scans(RULES) == 2


def test_keys_of_several_columns_do_not_run_together(spark):
    rows = {"t": spark.createDataFrame([(1, "a", "bc"), (2, "ab", "c")], "id long, x string, y string"), "p": spark.createDataFrame([(1, "a", "bc")], "id long, x string, y string")}
    rules = [contracts.Foreign("f", "t", ("x", "y"), "p", ("x", "y")), contracts.Unique("u", "t", ("x", "y"))]
    assert [tuple(r) for r in contracts.violations(rows, {"t": "id", "p": "id"}, rules).collect()] == [("f", "2")]


def test_first_failures_and_changes(spark):
    stages = [(c, s, "AVAILABLE") for c in "ab" for s in traces.STAGES[1:]] + [("a", "RETRIEVAL", "NOT_AVAILABLE"), ("c", "MERGER", "AVAILABLE"), ("c", "NORMALIZATION", "NOT_AVAILABLE"), ("d", "MERGER", "NOT_AVAILABLE")]
    events = [("a", 1, "MERGER", "PARENT_REMOVED", 11, "M"), ("a", 2, "PARENT_BINDING", "PARENT_REPLACED", 12, None), ("a", 3, "PARENT_BINDING", "PARENT_REMOVED", 13, "B"), ("a", 0, "RETRIEVAL", "PARENT_REMOVED", 10, "R"),
              ("b", 1, "MERGER", "RESULT_MERGED", 14, "X"), ("c", 1, "MERGER", "PARENT_REMOVED", 15, "Y")]
    s = spark.createDataFrame(stages, "candidate string, stage string, availability string")
    e = spark.createDataFrame(events, "candidate string, ordinal int, stage string, event_type string, event_id long, reason_code string")
    got = {r.candidate: tuple(r)[1:] for r in traces.first_failures(s, e).collect()}
    assert got == {"a": ("PARENT_BINDING", 12, "OTHER", "COMPLETE"), "b": ("UNKNOWN", None, "OTHER", "COMPLETE"), "c": ("UNKNOWN", None, "ARTIFACT_NOT_AVAILABLE", "PARTIAL"), "d": ("UNKNOWN", None, "ARTIFACT_NOT_AVAILABLE", "PARTIAL")}
    assert {r.candidate: r.trace for r in traces.availability(s).collect()} == {"a": "PARTIAL", "b": "AVAILABLE", "c": "PARTIAL", "d": "NOT_AVAILABLE"}
    parents = spark.createDataFrame([("a", 1, 1, None), ("a", 2, 2, "p"), ("a", 3, 3, "p"), ("a", 4, 4, "q"), ("a", 5, 5, None), ("b", 1, 6, "z")], "candidate string, ordinal int, event_id long, parent string")
    assert sorted((r.event_id, r.change) for r in traces.parent_changes(parents).collect()) == [(2, "ADDED"), (4, "REPLACED"), (5, "REMOVED"), (6, "ADDED")]


def test_summary_keeps_zeros(spark):
    fields = spark.createDataFrame([("Arm", "EXACT", "PRESENT", True, "f"), ("Arm", "NOT_EXTRACTED", "SOURCE_CONFLICT", True, "f"), ("Arm", "ENTITY_MISSING", "PRESENT", False, "g"), ("Arm", "EXACT", "REVIEW_REQUIRED", True, "f")], "kind string, classification string, gold_status string, matched boolean, field string")
    got = {(r.section, r.a, r.b): r.n for r in metrics.benchmark_summary(fields, ["Arm", "Outcome"]).collect()}
    assert {k: n for k, n in got.items() if n} == {("targets", "Arm", None): 3, ("layer", "Arm", "exact"): 1, ("layer", "Arm", "entity_missing_cascade"): 1, ("root", "STRUCTURE", None): 1, ("root", "COVERAGE", None): 1, ("abstained", "f", None): 1}
    assert len(got) == 2 + 2 * 5 + 6 + 1 and got["layer", "Outcome", "exact"] == 0


def test_representatives_without_gathering_a_group(spark):
    rows = spark.createDataFrame([("a", 3, None, 1.0), ("a", 2, 7, 1.0), ("a", 1, 7, 1.5), ("b", 4, None, None), ("c", 5, 1, 2.0), (None, 6, 1, 2.0), (None, 7, 1, 2.0)], "g string, id int, n int, v double")
    got = {r.g: (r.id, r.n_rows, r.status, r.selection) for r in merging.group_labels(rows, ["g"], "v", ["n"], ["id"]).collect()}
    assert got == {"a": (1, 3, "conflict", "most_complete"), "b": (4, 1, "unresolved", "single"), "c": (5, 1, "single", "single"), None: (6, 2, "duplicate", "most_complete")}
    plan = merging.group_labels(rows, ["g"], "v", ["n"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
