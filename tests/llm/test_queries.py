"""All dealt queries are registered; those with SQL agree with it on a second engine."""

import duckdb
import pytest

import __spark_entry__
from lumenweave.llm.queries import QUERIES
from lumenweave.llm.sql import ORACLE_SQL

from .conftest import SF


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert set(QUERIES) <= names


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def compare(spark, name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    got = QUERIES[name](spark, sf_dir).select(*columns).collect()
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    assert key(got) == key(found.fetchall())
    return got


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    compare(spark, name, SF)


def test_learned_cutoffs_against_sql(spark):
    """Where there are labels enough for the bounds to prove cutoffs, and these reject documents."""
    rows = compare(spark, "op3_quality_rules", "/root/testdata/sf0.1")
    assert sum(not r.kept and not r.base_failed for r in rows) > 100
