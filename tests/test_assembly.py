"""Operators without a query of their own: digests of folders, introspection, reranking, answers from a question."""

import hashlib

from pyspark.sql import functions as F

from lumenweave.operators import answers, assembly, planning, topology
from lumenweave.sources import sinks


def test_tree_digest(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "b" / "c.txt").write_bytes(b"two")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    got = assembly.tree_digest(files, f"{tmp_path}/").first()
    sha = lambda data: hashlib.sha256(data).hexdigest()
    folders = [f"{name} {sha(f'{file} {sha(data)}'.encode())}" for name, file, data in (("", "a.txt", b"one"), ("b/", "c.txt", b"two"))]
    assert (got.digest, got.n) == (sha("\n".join(sorted(folders)).encode()), 2)


def test_field_ids(spark):
    frames = [spark.createDataFrame([(1, 2)], "b int, a int"), spark.createDataFrame([(1, 2)], "c int, a int")]
    assert planning.field_ids(frames, frozenset({"c"})) == ["a", "b"]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 0.5, "x" * 2000), (2, 0.25, "y")], "id int, score double, summary string")
    got = {r.id: (r.score, len(r.summary)) for r in answers.rerank(hits, F.when(F.col("id") == 1, 7.0)).collect()}
    assert got == {1: (1.0, 1500), 2: (0.25, 1)}


def test_answer_to_a_question(spark):
    docs = spark.createDataFrame([(1, "pain fell after needles"), (2, "nothing here"), (3, "needles needles")], "doc_id long, text string")
    against = spark.createDataFrame([("needles", "c1", "conflict"), ("needles", "c2", "agreement")], "query string, contradiction_id string, status string")
    r = answers.answer(docs, ["needles"], 2, against).first()
    assert r.answer == "needles needles [cite: 3]\npain fell after needles [cite: 1]"
    assert (r.citation_ids, r.unsupported, r.contradiction_ids) == (["1", "3"], [], ["c1"])


def test_cell_specs_of_damaged_rows(spark):
    cells = lambda row: spark.range(1).select(topology.cell_specs(F.lit(row)).alias("c")).first().c
    assert [tuple(c) for c in cells("<tr><td rowspan=x>a</td><td colspan='0'>b</td></tr>")] == [("a", 1, 1), ("b", 1, 1)]
    assert cells("<tr></tr>") == []


def test_append_log(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, event string")
    more = spark.createDataFrame([("d", 2), ("c", 1)], "event string, at int")
    got = sinks.append_log(log, more, "at").select("seq", "event").collect()
    assert sorted(tuple(r) for r in got) == [(3, "c"), (4, "d")]
    assert [r.seq for r in sinks.append_log(log.limit(0), more.limit(1), "at").collect()] == [1]


def test_write_jsonl(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"a":1,"b":null}']
