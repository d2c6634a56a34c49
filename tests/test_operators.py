"""Operators on small fixtures: merges, matchings, tables, sources, sinks, streams."""

import itertools

import pytest
from pyspark.sql import functions as F

from lumenweave.operators import documents, extraction, graph, matching, merging, metrics, numbering
from lumenweave.sources import readers, sinks
from lumenweave.streaming import ingest


def test_merge_does_not_depend_on_order(spark):
    seen = [("PRESENT", "1"), ("PRESENT", "1"), ("NOT_REPORTED", None), ("PRESENT", "2")]
    rows = [(i, s, v) for i, p in enumerate(itertools.permutations(seen)) for s, v in p]
    out = merging.merge_observations(spark.createDataFrame(rows, "k int, status string, value string"), ["k"], "status", "value")
    assert {(r.status, r.value, r.n_candidates) for r in out.collect()} == {("SOURCE_CONFLICT", None, 2)}
    mixed = spark.createDataFrame([(1, "UNRESOLVED", None), (1, "NOT_REPORTED", None), (2, "UNRESOLVED", None), (2, "UNRESOLVED", None), (3, "PRESENT", "x")], "k int, status string, value string")
    assert {r.k: (r.status, r.value) for r in merging.merge_observations(mixed, ["k"], "status", "value").collect()} == {1: ("REVIEW_REQUIRED", None), 2: ("UNRESOLVED", None), 3: ("PRESENT", "x")}


@pytest.mark.parametrize("gold, pred, matched, want", [
    ("REVIEW_REQUIRED", "PRESENT", True, None), ("SOURCE_CONFLICT", None, None, "SOURCE_CONFLICT_MISSED"), ("SOURCE_CONFLICT", "SOURCE_CONFLICT", None, "SOURCE_CONFLICT_DETECTED"), ("PRESENT", None, None, "ENTITY_MISSING"),
    ("PRESENT", "SOURCE_CONFLICT", None, "SOURCE_CONFLICT_SPURIOUS"), ("PRESENT", "UNRESOLVED", None, "NOT_EXTRACTED"), ("PRESENT", "PRESENT", True, "EXACT"), ("PRESENT", "PRESENT", False, "VALUE_WRONG"), ("NOT_REPORTED", "NOT_REPORTED", None, "EXACT"),
    ("NOT_REPORTED", "PRESENT", None, "FALSE_PRESENT"), ("PRESENT", "NOT_REPORTED", None, "FALSE_NR"), ("NOT_APPLICABLE", "NOT_REPORTED", None, "STATUS_WRONG"),
])
def test_classify(spark, gold, pred, matched, want):
    c = metrics.classify(F.lit(gold), F.lit(pred).cast("string"), F.lit(matched).cast("boolean"))
    assert spark.range(1).select(c).first()[0] == want


def test_rate_without_denominator(spark):
    assert spark.range(1).select(metrics.rate(F.lit(0), F.lit(0))).first()[0] is None


def test_uncertain_competitors_block(spark):
    edges = spark.createDataFrame([("a", "x", True), ("b", "y", True), ("b", "z", False), ("c", "w", False)], "g string, p string, safe boolean")
    assert {r.g for r in matching.unique_safe(edges, "g", "p", "safe").collect() if r.accepted} == {"a"}


def test_component_shapes(spark):
    edges = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3"), ("c", "4"), ("d", "4"), ("e", "5"), ("f", "5"), ("f", "6")], "gold string, pred string")
    assert {(r.gold, r.status) for r in graph.component_shapes(edges).collect()} == {("a", "MATCHED"), ("b", "SPLIT"), ("c", "MERGED"), ("d", "MERGED"), ("e", "AMBIGUOUS"), ("f", "AMBIGUOUS")}


def test_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in graph.components(edges).collect()} == {0}


def test_perfect_matching_needs_augmenting(spark):
    edges = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (2, "a", "x"), (2, "b", "x")], "g int, left string, right string")
    sizes = spark.createDataFrame([(1, 2, 2), (2, 2, 2), (3, 1, 1)], "g int, n_left int, n_right int")
    assert {r.g: r.perfect for r in graph.perfect_matching(edges, "g", sizes).collect()} == {1: True, 2: False, 3: False}


def test_fill_override_append(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, 5)], "k int, name string, n int")
    b = spark.createDataFrame([(1, "y", 7), (3, "z", None)], "k int, name string, n int")
    assert sorted(map(tuple, matching.merge_append(a, b, "k", ["name", "n"]).collect())) == [(1, "x", 7), (2, None, 5), (3, "z", None)]
    assert sorted(map(tuple, matching.override(a, b, "k", ["name", "n"]).collect())) == [(1, "y", 7, "name,n"), (2, None, 5, "")]
    assert {(r.rule, r.id) for r in matching.violations(a, "k", b, "k", "fk").collect()} == {("fk", "2")}


def test_markdown_routing_and_tables(spark):
    md = "# Abstract\nhello\n<!-- page 2 -->\n## 2. Methods\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 | 3 |\n# Odd heading\nend"
    rows = documents.routed(spark.createDataFrame([(1, md)], "id int, text string"), "id", "text")
    assert [(r.kind, r.page, r.section) for r in rows.orderBy("line").collect()] == [
        ("heading", 1, "ABSTRACT"), ("text", 1, "ABSTRACT"), ("page", 2, "ABSTRACT"), ("heading", 2, "METHODS"), ("table", 2, "METHODS"), ("table", 2, "METHODS"), ("table", 2, "METHODS"), ("heading", 2, "METHODS"), ("text", 2, "METHODS"),
    ]
    got = documents.cells(documents.pipe_tables(rows, "id"), "id").orderBy("row", "col").collect()
    assert [(r.header, r.cell) for r in got] == [("a", "1"), ("b|c", "2"), ("column 3", "3")]
    out = documents.markdown(rows.filter("kind = 'text'"), "id").first().markdown
    assert out == "<!-- page 1 -->\n## ABSTRACT\nhello\n<!-- page 2 -->\n## METHODS\nend"


def test_html_tables_and_spans(spark):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><TABLE><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></TABLE><table><tr><td>x</td></tr></table>"
    got = documents.html_tables(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").orderBy("table_id").collect()
    assert [(r.table_id, r.header, r.rows) for r in got] == [("table-1", ["A", "B"], [["1", "2"]]), ("table-2", None, [["x"]])]
    spans = spark.createDataFrame([(1, 0, 0, "a", 2, 1), (1, 0, 1, "b", 1, 2), (1, 1, 0, "c", 1, 1), (1, 1, 1, "d", 1, 1)], "t int, row int, place int, cell string, rowspan int, colspan int")
    assert [r.cell for r in documents.expand_spans(spans, ["t"]).orderBy("row", "col").collect()] == ["a", "b", "b", "a", "c", "d"]


def test_boilerplate(spark):
    rows = [(1, p, x) for p in range(4) for x in ("Journal of Things", f"text {p} own", str(p), "")]
    got = documents.boilerplate(spark.createDataFrame(rows, "d int, p int, x string"), "d", "p", "x")
    assert {r.x for r in got.filter("NOT is_boilerplate").collect()} == {f"text {p} own" for p in range(4)}


def test_extraction_retries_and_cache(spark):
    rows = spark.createDataFrame([(1, 0, "short one here now"), (1, 1, "long " * 200), (2, 0, "alone " * 200)], "d int, r int, x string")
    got = extraction.sharded(rows, "d", "r", "x")
    assert {(r.d, r.r): r.mode for r in got.collect()} == {(1, 0): "first", (1, 1): "retried", (2, 0): "first"}
    never = extraction.sharded(rows, "d", "r", "x", lambda shard: {})
    assert {r.mode for r in never.collect()} == {"missing"}
    assert extraction.planned(rows, got, "x").count() == 0 and extraction.planned(rows, never, "x").count() == 3


def test_shards_share_batches(spark):
    rows = spark.createDataFrame([(d, r, f"{d} {r} words") for d in range(300) for r in range(3)] + [(None, 0, "x"), (7, 9, "y" * 500)], "d long, r int, x string").repartition(3)
    done = extraction.sharded(rows, "d", "r", "x")
    assert "FlatMapGroups" not in done._jdf.queryExecution().executedPlan().toString()
    got = {(r.d, r.r): (r.output, r.mode) for r in done.collect()}
    assert len(got) == 902 and got[299, 2] == ("299 2 words", "first") and got[None, 0] == ("x", "first") and got[7, 9] == ("y" * 500, "retried")


def test_dense_numbers(spark):
    out = numbering.dense_numbers(spark.range(5000).select((F.col("id") * 37 % 5003).alias("k")), "n", "k").orderBy("k").collect()
    assert [r.n for r in out] == list(range(1, 5001))


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\nnot json\n[1]\n{"a": 2}\n{"a": \n')
    assert sorted(map(tuple, readers.tolerant_jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string").collect())) == [(1, "x"), (2, None)]
    (tmp_path / ".env").write_text("# c\nA=1\nB = 'two=2'\nA=3\n\nbroken\n")
    (tmp_path / "env.txt").write_text((tmp_path / ".env").read_text())
    assert {r.key: r.value for r in readers.key_values(spark, str(tmp_path / "env.txt")).collect()} == {"A": "3", "B": "two=2"}
    (tmp_path / "m.json").write_text('{"columns": [{"column": "A", "field": "x"}, {"column": "B", "field": "y"}]}')
    assert readers.codebook(spark, str(tmp_path / "m.json"), "s").count() == 2
    (tmp_path / "2015-06 x.pdf").write_bytes(b"123")
    (tmp_path / "2016-01.pdf").write_bytes(b"1")
    assert {r.study_id for r in readers.discover(spark, str(tmp_path), "*.pdf").collect()} == {"2015-06", "2016-01"}
    assert readers.discover(spark, str(tmp_path), "*.pdf", year="2016").first().n_bytes == 1
    ids = spark.createDataFrame([("S1",), ("S1-A",), ("S12",)], "id string")
    assert {r.id for r in readers.prefixed(ids, "id", "S1").collect()} == {"S1", "S1-A"}


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "<y>")], "k int, v string")
    sinks.write_table(a, f"{tmp_path}/t", ["k"])
    sinks.write_table(spark.createDataFrame([(2, "z"), (3, None)], "k int, v string"), f"{tmp_path}/t", ["k"])
    assert sorted(map(tuple, sinks.read_table(spark, f"{tmp_path}/t").collect())) == [(1, "x"), (2, "z"), (3, None)]
    sinks.write_jsonl(a, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    one = sinks.publish_snapshot(a.coalesce(1), f"{tmp_path}/s1").first().digest
    assert one == sinks.publish_snapshot(a.orderBy(F.desc("k")).coalesce(1), f"{tmp_path}/s2").first().digest
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.publish_snapshot(a, f"{tmp_path}/s1")
    assert sinks.html_rows(a, ["k", "v"]).filter("value = '<tr><td>2</td><td>&lt;y&gt;</td></tr>'").count() == 1
    assert sinks.fixed_columns(a, ["v", "w"]).columns == ["v", "w"] and sinks.fixed_columns(a, ["w"]).first().w == "NR"
    assert sinks.write_once_cache(a, spark.createDataFrame([(1, "new"), (9, "b"), (9, "a")], "k int, v string"), "k").count() == 3
    assert sinks.markdown_report(a, "k", ["v"]).filter("k = 1").first().report == "## 1\n\n- v: x"


def test_append_only(spark):
    a = spark.createDataFrame([("i", "x")], "id string, v string")
    out = merging.append_only(a, spark.createDataFrame([("i", "x"), ("i", "y"), ("j", "x")], "id string, v string"), "id", ["v"])
    assert sorted(map(tuple, out.collect())) == [("i", "x"), ("i-retry-01", "y"), ("j", "x")]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", 1.0), (1, "2024-01-01 00:10:00", 1.0), (2, "2024-01-01 00:50:00", 2.0), (3, "2024-01-01 05:00:00", 4.0)], "id int, at string, v double").withColumn("at", F.col("at").cast("timestamp")).withColumn("g", F.lit("a"))
    rows.write.parquet(f"{tmp_path}/in")
    schema = "id int, at timestamp, v double, g string"
    ingest.write(ingest.once(ingest.documents(spark, f"{tmp_path}/in", schema), ["id"], "at"), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    counts = ingest.windowed_counts(ingest.documents(spark, f"{tmp_path}/in", schema), "at", "g", "v")
    ingest.write(counts, f"{tmp_path}/w", f"{tmp_path}/c2").awaitTermination(120)
    assert [(r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/w").collect()] == [(3, 4.0)]
