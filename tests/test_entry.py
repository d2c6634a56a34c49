"""The driver's contract holds, with and without the subpackage for training data."""

import sys

import __spark_entry__
from lumenweave.plans import QUERIES


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "hard_exact" in df.columns


def test_every_sql_has_a_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(QUERIES) <= set(queries) and len(QUERIES) > 90


def test_without_the_training_data_part(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("lumenweave.llm")] + ["lumenweave.llm", "lumenweave.llm.queries", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert all(n in QUERIES for n in __spark_entry__.oracle_sql())
