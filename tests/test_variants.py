"""Nested JSON as rows against a plain recursion."""

import json
from pathlib import Path

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenweave.operators import variants
from lumenweave.shared import shared_dir


def walk(value, path="", key=""):
    if isinstance(value, dict):
        for k, child in value.items():
            yield from walk(child, f"{path}.{k}" if path else k, k)
    elif isinstance(value, list):
        if key == "evidence":
            yield path, "evidence", str(len(value))
        elif any(isinstance(x, dict | list) for x in value):
            for i, child in enumerate(value):
                yield from walk(child, f"{path}[{i}]")
        else:
            yield path, "list", json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    else:
        yield path, "value", None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


KEYS = st.sampled_from(["a", "b", "evidence", "name", "ünï", "with space"])
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.sampled_from(["", "x", "[no list", "{no object", "Ünï"]), lambda inner: st.lists(inner, max_size=3) | st.dictionaries(KEYS, inner, max_size=3), max_leaves=12)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(VALUES, min_size=25, max_size=25))
def test_flatten_any_depth(spark, values):
    rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], "id long, j string")
    got = sorted(((r.id, r.path, r.kind, r.value) for r in variants.flatten(rows, ["id"], "j").collect()), key=str)
    assert got == sorted(((i, *x) for i, v in enumerate(values) for x in walk(v)), key=str)


def test_flatten_edges(spark):
    deep = "1"
    for i in range(12):
        deep = f'{{"k{i}": [{deep}, {{}}]}}'
    rows = spark.createDataFrame([(1, None), (2, "{"), (3, "{}"), (4, "[]"), (5, deep), (6, '{"a": 1, "a": 2}'), (6, '{"b": null}')], "id long, j string")
    got = sorted(((r.id, r.path, r.kind, r.value) for r in variants.flatten(rows, ["id"], "j").collect()), key=str)
    path = ".".join(f"k{i}[0]" for i in range(11, -1, -1))
    assert got == sorted([(2, "", "unreadable", None), (4, "", "list", "[]"), (5, path, "value", "1"), (6, "", "unreadable", None), (6, "b", "value", None)], key=str)
    assert variants.flatten(rows.limit(0), ["id"], "j").count() == 0


def test_first_present(spark):
    cases = [('{"b": 2, "a": 1}', "1"), ('{"a": null, "b": 2}', None), ('{"b": 2}', "2"), ('{"c": 2}', None), ('{"o\'c": "x"}', "x"), ("[1]", None), ('{"b": {"a": [1]}}', '{"a":[1]}')]
    rows = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(cases)], "id long, j string")
    got = rows.select("id", variants.first_present(F.parse_json("j"), "a", "b", "o'c").alias("v")).orderBy("id").collect()
    assert [r.v for r in got] == [v for _, v in cases]


def test_flatten_is_one_pass_and_writes_values_as_variants_do(spark):
    before = {f.name for f in Path(shared_dir(spark).removeprefix("file://")).glob("lumenweave-*")}
    odd = ['{"a": 1.50, "b": 1e3, "c": -0, "d": 123456789012345678901234567890, "e": 0.0001, "f": 1E-7, "g": 12345678901234567890.123}', '[1.50, "\\u0001", "ü\\"/\\\\", -0, 1e3, null, true]', '"\\ud800x"', '["\\ud800x"]', ' \n{"a": 1} {"b"', '{"a": {"": [], "x.y": {}, "evidence": {"evidence": 1}}}', '[[], [[]], {"evidence": [[1]]}]', "[" * 300 + "]" * 300, "nul", "", "null", "true"]
    rows = spark.createDataFrame(list(enumerate(odd)), "id long, j string")
    got = sorted(tuple(r) for r in variants.flatten(rows, ["id"], "j").collect() if r.id != 7)
    scalar = lambda x: spark.sql("SELECT CAST(parse_json(:x) AS string) AS v", {"x": x}).first()["v"]
    want = [(0, k, "value", scalar(v)) for k, v in [("a", "1.50"), ("b", "1e3"), ("c", "-0"), ("d", "123456789012345678901234567890"), ("e", "0.0001"), ("f", "1E-7"), ("g", "12345678901234567890.123")]]
    want += [(1, "", "list", spark.sql("SELECT to_json(parse_json(:x)) AS v", {"x": odd[1]}).first()["v"]), (2, "", "value", "?x"), (3, "", "list", '["?x"]'), (4, "a", "value", "1")]
    want += [(5, "a.", "list", "[]"), (5, "a.evidence.evidence", "value", "1"), (6, "[0]", "list", "[]"), (6, "[1][0]", "list", "[]"), (6, "[2].evidence", "evidence", "1")]
    want += [(8, "", "unreadable", None), (9, "", "unreadable", None), (10, "", "value", None), (11, "", "value", "true")]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {f.name for f in Path(shared_dir(spark).removeprefix("file://")).glob("lumenweave-*")} == before
