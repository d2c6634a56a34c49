"""Extraction through an injected function: sharded, cached by content, with what was left out retried.

The extractor stands for an external service.  It gets a shard of (row id,
content) and returns what it covered; nothing is taken on trust, and rows that
it left out are sent again one by one.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Extractor = Callable[[list[tuple[int, str]]], dict[int, str]]


def first_words(shard: list[tuple[int, str]]) -> dict[int, str]:
    """The offline stub: the first three words of each row; rows over 400 characters only when they come alone."""
    return {i: " ".join(x.split()[:3]) for i, x in shard if len(x) <= 400 or len(shard) == 1}


def sharded(rows: DataFrame, shard: str, row: str, content: str, extractor: Extractor = first_words) -> DataFrame:
    """(shard, row, output, mode, input_hash) of every row: mode is ``first``, ``retried`` or ``missing``."""

    @F.pandas_udf("output array<string>, mode array<string>")
    def run(ids: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for one, texts in zip(ids, contents, strict=True):
            asked = list(zip(one.tolist(), texts.tolist(), strict=True))
            got = dict(extractor(asked))
            mode = dict.fromkeys(got, "first")
            for i, x in asked:
                if i not in got and (again := extractor([(i, x)])).get(i) is not None:
                    got[i], mode[i] = again[i], "retried"
            out.append(([got.get(i) for i, _ in asked], [mode.get(i, "missing") for i, _ in asked]))
        return pd.DataFrame(out, columns=["output", "mode"])

    # A shard is a row, so that many share a batch; contents do not come back from Python.
    held = rows.groupBy(shard).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("i"), F.col(content).alias("x")))).alias("_asked"))
    done = held.select(shard, "_asked", run(F.col("_asked.i"), F.col("_asked.x")).alias("_got"))
    each = done.select(shard, F.explode(F.arrays_zip("_asked", F.col("_got.output").alias("output"), F.col("_got.mode").alias("mode"))).alias("r"))
    return each.select(shard, F.col("r._asked.i").alias(row), "r.output", "r.mode", F.sha2("r._asked.x", 256).alias("input_hash"))


def planned(rows: DataFrame, cache: DataFrame, content: str) -> DataFrame:
    """Rows whose content has no successful entry in ``cache`` (input_hash, mode)."""
    done = cache.filter("mode <> 'missing'").select("input_hash").distinct()
    return rows.withColumn("input_hash", F.sha2(content, 256)).join(done, "input_hash", "left_anti")
