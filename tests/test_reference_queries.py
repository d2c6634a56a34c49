"""Every registered query against its SQL on a second engine; those without SQL have rows and a stable schema."""

import math

import duckdb
import pytest

from lumenweave.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in ORACLE_SQL:
        found = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, found.fetchall())
