"""Shared pieces: text bounds, tables, what workers keep, free column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop_path, fresh_path
from ..shared import written as materialize

__all__ = ["SPACE", "SPACE_CHARS", "drop_path", "fresh_names", "fresh_path", "materialize", "table", "word_count", "worker_state"]

#: What separates words in the contracts of several operators, as a Java regex class body.
SPACE = r"\x20\x09-\x0D"
#: The same six characters, for trim and translate.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.expr("0") + F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_worker: dict = {}


def worker_state(key, make):
    """What a Python worker keeps from task to task, made by ``make``; whatever was kept under another key goes first.

    Workers serve one operator after another, so that each operator's tables would else stay until the session ends.
    """
    if key not in _worker:
        _worker.clear()
        _worker[key] = make()
    return _worker[key]


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
