"""Merging observations without losing conflicts or kinds of missingness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states of a field.
STATUSES = ("PRESENT", "NOT_REPORTED", "NOT_APPLICABLE", "INSUFFICIENT_CONTEXT", "UNRESOLVED", "SOURCE_CONFLICT", "REVIEW_REQUIRED")


def merge_observations(rows: DataFrame, keys: list[str], status: str, value: str) -> DataFrame:
    """One field a key: status, value, n_candidates, candidates.

    One distinct present value is PRESENT, several are a SOURCE_CONFLICT with all
    of them as candidates and no value; none present keeps the common status,
    and differing ones need review.  Aggregates only, so any order gives the same.
    """
    present = F.when(F.col(status) == "PRESENT", F.col(value))
    out = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_set(present)).alias("candidates"),
        F.min(F.when(F.col(status) != "PRESENT", F.col(status))).alias("_least"),
        F.max(F.when(F.col(status) != "PRESENT", F.col(status))).alias("_most"),
    )
    n = F.size("candidates")
    state = F.when(n == 1, "PRESENT").when(n > 1, "SOURCE_CONFLICT").when(F.col("_least") == F.col("_most"), F.col("_least")).otherwise("REVIEW_REQUIRED")
    return out.select(*keys, state.alias("status"), F.when(n == 1, F.get("candidates", 0)).alias("value"), n.cast("long").alias("n_candidates"), "candidates")


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ``order`` must be total."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace current ones of the same key."""
    return current.join(incoming.select(*keys), keys, "left_anti").select(*current.columns).unionByName(incoming)


def append_only(current: DataFrame, incoming: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Identical duplicates are dropped; a key in use for other content gets ``-retry-NN``."""
    known = current.select(key, *[F.col(c).alias(f"_{c}") for c in content]).dropDuplicates([key]).withColumn("_known", F.lit(True))
    same = F.lit(True)
    for c in content:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    told = incoming.join(known, key, "left").filter(F.col("_known").isNull() | ~same)
    fresh = told.filter(F.col("_known").isNull())
    clash = told.filter(F.col("_known").isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*content)))
    renamed = clash.withColumn(key, F.concat(F.col(key), F.lit("-retry-"), F.lpad(F.col("_n").cast("string"), 2, "0")))
    return current.unionByName(fresh.select(*current.columns)).unionByName(renamed.select(*current.columns))


def completeness(*columns: Column) -> Column:
    """How many of the columns hold something."""
    return sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))


def group_labels(rows: DataFrame, keys: list[str], value: str, most: list[str], least: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Each group's representative, how it was chosen, and what its rows say.

    The representative is the row with the greatest ``most`` (numbers, null last), then the smallest ``least``.  status
    is conflict if values spread beyond the tolerance, duplicate if they agree, single otherwise; unresolved without any
    value.  Aggregates only, so that a group of any size is reduced task by task.
    """
    others = [c for c in rows.columns if c not in keys]
    order = F.struct(*[x for c in most for x in (F.col(c).isNull().alias(f"no_{c}"), (-F.col(c)).alias(f"less_{c}"))], *least)
    spread = F.max(value) - F.min(value)
    status = F.when(F.count(value) == 0, "unresolved").when(spread > tolerance, "conflict").when(F.count("*") > 1, "duplicate").otherwise("single")
    label = F.when(F.count("*") == 1, "single").otherwise("most_complete")
    out = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_row"), F.count("*").alias("n_rows"), status.alias("status"), label.alias("selection"))
    return out.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in others], "n_rows", "status", "selection")
