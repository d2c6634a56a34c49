"""Joins that answer only where the answer is unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_safe(edges: DataFrame, left: str, right: str, safe: str | None = None) -> DataFrame:
    """``edges`` with ``accepted``: both ends have this one edge, and it is safe.

    All viable edges count for the degrees; safety is asked only afterwards, so
    that an uncertain competitor blocks and never wins.  Each end is aggregated,
    and what either end holds alone is met by both, so that no end with very
    many edges gathers them in a task.  A null end is never accepted.
    """
    sure = F.col(safe) if safe else F.lit(True)
    alone = lambda end, other: edges.groupBy(end).agg(F.count("*").alias("_n"), F.min(other).alias(other)).filter("_n = 1").drop("_n")
    pairs = alone(left, right).join(alone(right, left), [left, right]).withColumn("_one", F.lit(True))
    out = edges.join(pairs, [left, right], "left")
    return out.select(*edges.columns, (F.coalesce("_one", F.lit(False)) & sure).alias("accepted"))


def unique_lookup(rows: DataFrame, aliases: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of the alias table where exactly one value owns the key, else null."""
    owners = aliases.groupBy(key).agg(F.min(value).alias(value), F.countDistinct(value).alias("_n")).filter("_n = 1").drop("_n")
    return rows.join(owners, key, "left")


def fill_missing(rows: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Values already there are authoritative; nulls are filled from the row of ``other`` with the same keys."""
    filled = other.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(filled, keys, "left")
    return out.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])


def merge_append(rows: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``fill_missing`` by one key, and rows of ``other`` whose key is new appended."""
    fresh = other.join(rows.select(key), key, "left_anti")
    return fill_missing(rows, other, [key], columns).unionByName(fresh.select(*rows.columns))


def override(rows: DataFrame, authority: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Authoritative values replace others; ``changed`` lists the columns that differ."""
    told = authority.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(told, key, "left")
    differs = [F.when(F.col(f"_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]
    return out.withColumn("changed", F.array_join(F.array_compact(F.array(*differs)), ",")).select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns], "changed"
    )


def violations(child: DataFrame, column: str, parent: DataFrame, key: str, rule: str) -> DataFrame:
    """(rule, id) of references without a target, distinct."""
    missing = child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_k")), F.col(column) == F.col("_k"), "left_anti")
    return missing.select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("id")).distinct()


def repeated_keys(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    return rows.groupBy(*keys).count().filter("count > 1").select(F.lit(rule).alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("id"))


def same_set(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """One row: sizes, what either side lacks, and whether the sets are equal; null never counts."""
    l, r = (x.select(column).filter(F.col(column).isNotNull()).distinct() for x in (left, right))
    both = l.withColumn("l", F.lit(1)).join(r.withColumn("r", F.lit(1)), column, "full")
    return both.agg(
        F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def first_reason(steps: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first step whose condition fails."""
    out = F.lit(otherwise)
    for name, ok in reversed(steps):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out
