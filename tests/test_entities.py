"""Two small graphs matched kind by kind, and answers in odd shapes."""

import pytest
from pyspark.sql import functions as F

from lumenweave.functions import responses
from lumenweave.operators import entities
from lumenweave.operators.entities import ENTITY, match_entities


def side(spark, *rows):
    """(kind, id, [(parent kind, parent id, reason)], fixed, [(name, method)])"""
    return spark.createDataFrame([(*r, None) for r in rows], ENTITY)


def exact(kind, id, *refs):
    return kind, id, [(*r, None) for r in refs], None, [(id, "EXACT_ID")]


def arm(id, label, method="SEMANTIC_IDENTITY"):
    return "Arm", id, [("Study", "s", None)], None, [(label, method)]


def result(id, arm_id, time):
    return "ArmResult", id, [("Arm", arm_id, "ARM_BINDING_UNRESOLVED")], time, [("", "COMPOSITE_IDENTITY")]


def test_levels(spark):
    top = (exact("Article", "a"), exact("Study", "s", ("Article", "a")))
    gold = side(
        spark, *top, arm("g1", "one"), arm("same", "old"), arm("g3", "twin"), arm("g4", "twin"), ("Outcome", "o", [("Study", "s", None)], None, [("pain", "SEMANTIC_IDENTITY")]),
        result("r1", "g1", "w4"), result("r2", "same", None), result("r3", "g3", "w4"), result("r4", "g1", "w8"),
    )
    pred = side(
        spark, *top, arm("p1", "one"), arm("same", "one"), arm("p3", "twin"), arm("p5", None), *[("Outcome", f"q{i}", [("Study", "s", None)], None, [("pain", "SEMANTIC_IDENTITY")]) for i in (1, 2)],
        result("t1", "p1", "w4"), result("t2", "same", None), result("t3", "p3", "w4"), result("t4", "p1", "w4"),
    )
    got = {(r.kind, r.gold_id, r.pred_id): (r.status, r.method or r.reason) for r in match_entities(gold, pred).collect()}
    assert got == {
        ("Article", "a", "a"): ("MATCHED", "EXACT_ID"),
        ("Study", "s", "s"): ("MATCHED", "EXACT_ID"),
        ("Arm", "g1", "p1"): ("MATCHED", "SEMANTIC_IDENTITY"),
        ("Arm", "same", "same"): ("MATCHED", "EXACT_ID"),
        ("Arm", "g3", None): ("AMBIGUOUS", "ENTITY_AMBIGUOUS"),
        ("Arm", "g4", None): ("AMBIGUOUS", "ENTITY_AMBIGUOUS"),
        ("Arm", None, "p3"): ("AMBIGUOUS", "ENTITY_AMBIGUOUS"),
        ("Arm", None, "p5"): ("EXTRA", "ENTITY_EXTRA"),
        ("Outcome", "o", None): ("SPLIT", "OUTCOME_IDENTITY_SPLIT"),
        ("Outcome", None, "q1"): ("SPLIT", "OUTCOME_IDENTITY_SPLIT"),
        ("Outcome", None, "q2"): ("SPLIT", "OUTCOME_IDENTITY_SPLIT"),
        ("ArmResult", "r1", None): ("AMBIGUOUS", "ENTITY_AMBIGUOUS"),
        ("ArmResult", None, "t1"): ("AMBIGUOUS", "ENTITY_AMBIGUOUS"),
        ("ArmResult", None, "t4"): ("AMBIGUOUS", "ENTITY_AMBIGUOUS"),
        ("ArmResult", "r2", "t2"): ("MATCHED", "COMPOSITE_IDENTITY"),
        ("ArmResult", "r3", None): ("MISSING", "ENTITY_MISSING"),
        ("ArmResult", "r4", None): ("MISSING", "ENTITY_MISSING"),
        ("ArmResult", None, "t3"): ("EXTRA", "ARM_BINDING_UNRESOLVED"),
    }


def test_equal_names_make_no_product(spark):
    """300 equal names on either side are one component, and the pair beside them is still matched."""
    top = (exact("Article", "a"), exact("Study", "s", ("Article", "a")))
    gold = side(spark, *top, arm("g", "one"), *[arm(f"g{i}", "twin") for i in range(300)])
    pred = side(spark, *top, arm("p", "one"), *[arm(f"p{i}", "twin") for i in range(300)])
    got = match_entities(gold, pred).filter("kind = 'Arm'").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"MATCHED": 1, "AMBIGUOUS": 600}


def test_entities_of_one_name_are_judged_once(spark, monkeypatch):
    """Neither the sides nor edges are written where no entity has two names: one table a level."""
    names, written = [], entities.written
    monkeypatch.setattr(entities, "written", lambda df, name: names.append(name) or written(df, name))
    rows = exact("Article", "a"), exact("Study", "s", ("Article", "a")), arm("g", "one"), result("r", "g", "w4")
    got = match_entities(side(spark, *rows), side(spark, *rows)).collect()
    assert {(r.kind, r.status) for r in got} == {(k, "MATCHED") for k in ("Article", "Study", "Arm", "ArmResult")}
    assert names == ["judged"] * len(entities.LEVELS)


def odd_side(spark, x):
    """Parents of any number and order, null ids, names, parents and times, a name by two methods."""
    top = [exact("Article", "a"), exact("Study", "s", ("Article", "a")), exact("Study", "t", ("Article", "b")), exact("Study", None, ("Article", "a"))]
    arms = [arm(f"{x}{i}", f"n{i}") for i in range(6)] + [arm(f"{x}6", "n6"), arm(None, "n1"), arm(f"{x}7", None)]
    arms.append(("Arm", f"{x}8", [("Study", "s", None)], None, [("n8", "SEMANTIC_IDENTITY"), ("n8", "GOLD_ALIAS"), (None, "GOLD_ALIAS")]))
    arms.append(("Arm", f"{x}9", [("Study", "s", None), ("Study", None, "LOST")], None, [("n9", "SEMANTIC_IDENTITY")]))
    of = lambda id, order: ("Intervention", id, [("Study", "s", None), *[("Arm", f"{x}{i}", "UNBOUND") for i in order]], None, [("needle", "SEMANTIC_IDENTITY")])
    order = [0, 1, 2, 3, 4] if x == "g" else [3, 1, 4, 0, 2]
    return side(spark, *top, *arms, of("many", order), of("two", order[:2]), of("one", [0]), of("gone", [7]), of("none", []), result("r", f"{x}1", None), result("q", f"{x}1", ""), result("l", f"{x}7", "w"))


@pytest.mark.parametrize("wide, few", [(4, 100), (0, 100), (2, -1), (9, -1)])
def test_parents_are_found_by_any_join(spark, monkeypatch, wide, few):
    monkeypatch.setattr(entities, "WIDE", wide)
    monkeypatch.setattr(entities, "FEW", few)
    got = {(r.kind, r.gold_id, r.pred_id): (r.status, r.method or r.reason) for r in match_entities(odd_side(spark, "g"), odd_side(spark, "p")).collect()}
    assert {k: v for k, v in got.items() if v[0] == "MATCHED"} == {
        ("Article", "a", "a"): ("MATCHED", "EXACT_ID"), ("Study", "s", "s"): ("MATCHED", "EXACT_ID"),
        **{("Arm", f"g{i}", f"p{i}"): ("MATCHED", "SEMANTIC_IDENTITY") for i in (0, 1, 2, 3, 4, 5, 6, 8)},
        ("Intervention", "many", "many"): ("MATCHED", "SEMANTIC_IDENTITY"), ("Intervention", "one", "one"): ("MATCHED", "SEMANTIC_IDENTITY"), ("Intervention", "none", "none"): ("MATCHED", "SEMANTIC_IDENTITY"),
        ("ArmResult", "r", "r"): ("MATCHED", "COMPOSITE_IDENTITY"), ("ArmResult", "q", "q"): ("MATCHED", "COMPOSITE_IDENTITY"),
    }
    assert got["Intervention", None, "gone"] == ("EXTRA", "UNBOUND") and got["Arm", None, "p9"] == ("EXTRA", "LOST") and got["ArmResult", None, "l"] == ("EXTRA", "ARM_BINDING_UNRESOLVED")
    assert got["Study", None, None] == ("EXTRA", "ENTITY_EXTRA") or got["Study", None, None] == ("MISSING", "ENTITY_MISSING")


def test_no_entities(spark):
    assert match_entities(side(spark), side(spark)).count() == 0


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ("unknown", None, "NR")),
        ("", ("unknown", None, "NR")),
        ("[1]", ("unknown", None, "NR")),
        ('{"table_classification": {"category": "Endpoint", "confidence": "0.5"}}', ("outcome", 0.5, "NR")),
        ('{"category": "safety", "confidence": "NR", "explanation": " as told "}', ("safety", None, "as told")),
        ('{"table_type": "adverse-event", "confidence": -0.1}', ("safety", None, "NR")),
    ],
)
def test_table_category(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(responses.table_category(F.col("raw")).alias("r")).select("r.*").first()
    assert tuple(got) == want


@pytest.mark.parametrize("raw, labels", [(None, []), ("NR", []), (" ", []), ("[broken", []), ("Sham ", ["Sham"]), ('["a", null, {"name": "b"}, " "]', ["a", "b", "NR"])])
def test_arms(spark, raw, labels):
    got = spark.createDataFrame([(raw,)], "raw string").select(responses.arms(F.col("raw")).alias("r")).first().r
    assert [x.arm_label for x in got] == labels


def test_records_and_support(spark):
    raw = [(None,), ("x",), ('{"records": []}',), ('{"outcomes": [{"index": 1.5}, {"index": 2, "status": "unknown", "conflict_fields": "time"}]}',)]
    got = [r.r for r in spark.createDataFrame(raw, "raw string").coalesce(1).select(responses.records(F.col("raw")).alias("r")).collect()]
    assert [len(x) for x in got] == [0, 0, 0, 1]
    assert (got[3][0].source_index, got[3][0].annotation_status, got[3][0].conflict_fields) == (2, "unresolved", ["time"])
    import pandas as pd

    deep = '{"field_id":1,"quote":"Q","source":"T"}'
    for _ in range(200):
        deep = f"[{deep}]"
    out = responses.lower_support(pd.Series([None, "x", deep]))
    assert out[0] is None and out[1] == "x" and out[2] == deep.replace('"T"', '"t"')
