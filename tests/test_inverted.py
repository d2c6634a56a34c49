"""The stored index: equal to a scan, buckets and blocks read, segments, refusals."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lumenweave.operators import inverted, retrieval


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    dice = random.Random(4)
    rare = [f"rare{i}" for i in range(300)]
    rows = [(i, " ".join(dice.choice(["common", "often", "seldom" if i % 50 == 0 else "often", dice.choice(rare)]) for _ in range(dice.choice([0, 3, 30, 200])))) for i in range(9000)]
    rows += [(9000, None), (9001, "- ! -"), (9002, "seldom " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path_factory.mktemp('index')}"
    for low, high in ((0, 8000), (8000, 9100)):
        inverted.append(docs.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high)), path)
    return docs, path


@pytest.mark.parametrize("words", [["common"], ["seldom", "common"], ["rare7", "often", "rare7"], ["rare1", "rare2", "rare3", "common"], ["absent"], ["absent", "seldom"]])
@pytest.mark.parametrize("k", [1, 10, 50])
def test_equal_to_a_scan(spark, indexed, words, k):
    docs, path = indexed
    want = retrieval.top_k(retrieval.bm25(docs, words).withColumn("score", F.round("score", 6)), k, F.desc("score"), F.asc("doc_id")).collect()
    got = inverted.search(spark, path, words, k).collect()
    assert [(r.doc, r.score) for r in got] == [(r.doc_id, r.score) for r in want]


def test_blocks_and_buckets_read(spark, indexed, capsys):
    _, path = indexed
    asked = inverted.Question(spark, path, ["common"], 10)
    every, kept = asked.blocks.count(), asked.kept().count()
    assert every > 40 and kept < every / 4
    plan = asked.kept()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    folders = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in asked.blocks.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert len(folders) == 1
    assert asked.blocks.agg(F.max(F.size("postings"))).first()[0] <= inverted.BLOCK


def test_what_is_indexed_is_refused(spark, indexed, tmp_path):
    docs, path = indexed
    with pytest.raises(ValueError, match="already"):
        inverted.append(docs.filter("doc_id = 8500"), path)
    with pytest.raises(ValueError, match="each"):
        inverted.append(docs.filter("doc_id = 3").union(docs.filter("doc_id = 3")), f"file://{tmp_path}/new")
    with pytest.raises(FileNotFoundError):
        inverted.search(spark, f"file://{tmp_path}/none", ["x"], 3)
    assert inverted.segments(spark, path) == [0, 1]


def test_what_is_not_committed_does_not_count(spark, tmp_path):
    """A writer that died between postings and commit leaves nothing that is read; the next takes a new number only where it can."""
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "doc_id long, text string")
    inverted.append(docs, path)
    inverted.append(spark.createDataFrame([(3, "alpha alpha gamma")], "doc_id long, text string"), path)
    stats = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stats/segment=1")
    stats.getFileSystem(spark._jsc.hadoopConfiguration()).delete(stats, True)
    assert [r.doc for r in inverted.search(spark, path, ["alpha"], 5).collect()] == [2, 1]
    with pytest.raises(Exception, match="exists|EXISTS"):
        inverted.append(spark.createDataFrame([(4, "alpha")], "doc_id long, text string"), path)


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    inverted.append(spark.createDataFrame([], "doc_id long, text string"), path)
    assert inverted.search(spark, path, ["x"], 5).count() == 0 and inverted.vocabulary(spark, path).count() == 0


def test_words_are_counted_without_a_shuffle(spark):
    texts = [[], ["b"], ["b", "a", "b", "ü", "b"], ["x"] * 700 + ["a"], [f"w{i % 90}" for i in range(1000)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, w array<string>").select("id", inverted._counted(F.array_append("w", F.lit(""))).alias("t"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r.id: [(t.term, t.tf) for t in r.t] for r in rows.collect()}
    assert got == {i: sorted(collections.Counter([*w, ""]).items()) for i, w in enumerate(texts)}
