"""Keyed tables: buckets rewritten, last writer, concurrent writers, earlier versions, vacuum."""

import pytest
from pyspark.sql import functions as F

from lumenweave.sources.keyed import ConcurrentWrite, KeyedTable


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def rows(spark, values):
    return spark.createDataFrame(values, "k long, t string, v int")


def held(table, version=None):
    return {(r.k, r.t): r.v for r in table.read(version).collect()}


def test_only_touched_buckets_are_rewritten(spark, path):
    table = KeyedTable(spark, path, ["k", "t"], 32)
    table.upsert(spark.range(5000).select(F.col("id").alias("k"), F.lit("a").alias("t"), F.lit(0).alias("v")))
    before = table.commit()["folders"]
    two = table.read().withColumn("b", table.bucket()).filter("b IN (3, 11)").filter(F.col("k") % 6 == 0).select("k", "t", F.lit(7).alias("v"))
    n = two.count()
    assert 10 < n < 100 and table.upsert(two) == 1
    after = table.commit()["folders"]
    assert {b for b in before if before[b] != after[b]} == {"3", "11"} and after.keys() == before.keys()
    assert table.read().count() == 5000 and table.read().filter("v = 7").count() == n
    assert table.read(0).filter("v = 7").count() == 0


def test_the_last_of_a_key_counts(spark, path):
    table = KeyedTable(spark, path, ["k", "t"], 4)
    table.upsert(rows(spark, [(1, "a", 5), (1, "a", 9), (1, None, 2), (None, None, 3), (2, "b", 1)]), order=["v"])
    assert held(table) == {(1, "a"): 9, (1, None): 2, (None, None): 3, (2, "b"): 1}
    table.upsert(rows(spark, [(None, None, 8), (1, None, None)]).select("v", "t", "k"))
    assert held(table) == {(1, "a"): 9, (1, None): None, (None, None): 8, (2, "b"): 1}
    assert table.upsert(rows(spark, []).limit(0)) == 2 and held(table) == held(table, 1)


def test_a_second_writer_is_refused(spark, path, monkeypatch):
    """Both read commit 0; the slower finds commit 1 taken, and nothing of its rows counts or stays."""
    table = KeyedTable(spark, path, ["k", "t"], 4)
    table.upsert(rows(spark, [(1, "a", 0), (2, "a", 0)]))
    slow, stale = KeyedTable(spark, path, ["k", "t"], 4), table.versions()
    table.upsert(rows(spark, [(1, "a", 1)]))
    monkeypatch.setattr(slow, "versions", lambda: stale)
    monkeypatch.setattr(slow, "commit", lambda version=None: KeyedTable.commit(table, 0))
    with pytest.raises(ConcurrentWrite):
        slow.upsert(rows(spark, [(2, "a", 2)]))
    assert held(table) == {(1, "a"): 1, (2, "a"): 0} and table.versions() == [0, 1]
    root, fs = table._at("data")
    assert sorted(s.getPath().getName()[:8] for s in fs.listStatus(root)) == ["00000000", "00000001"]
    monkeypatch.undo()
    assert slow.upsert(rows(spark, [(2, "a", 2)])) == 2 and held(table) == {(1, "a"): 1, (2, "a"): 2}


def test_what_no_commit_names_is_not_read(spark, path):
    table = KeyedTable(spark, path, ["k", "t"], 2)
    table.upsert(rows(spark, [(1, "a", 0)]))
    rows(spark, [(9, "z", 9)]).write.parquet(f"{path}/data/00000001-dead/__bucket=0")
    assert held(table) == {(1, "a"): 0}
    table.upsert(rows(spark, [(2, "b", 1)]))
    table.upsert(rows(spark, [(1, "a", 4), (2, "b", 4)]))
    assert table.vacuum() >= 2 and table.versions() == [2] and held(table) == {(1, "a"): 4, (2, "b"): 4}
    with pytest.raises(FileNotFoundError):
        table.read(0)


def test_other_keys_are_refused(spark, path):
    KeyedTable(spark, path, ["k", "t"], 2).upsert(rows(spark, [(1, "a", 0)]))
    with pytest.raises(ValueError):
        KeyedTable(spark, path, ["k"], 2).upsert(rows(spark, [(1, "a", 0)]))
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, path + "-none", ["k"]).read()
