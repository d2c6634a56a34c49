"""What a step may change: scope by field, measures that must stay, and repairs of surface forms that leave an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_fields(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, value): a row for each column that is no key, its value as text, nulls included."""
    fields = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in rows.columns if c not in keys]
    return rows.select(*keys, F.explode(F.array(*fields)).alias("x")).select(*keys, "x.*")


def out_of_scope(before: DataFrame, after: DataFrame, keys: list[str], allowed: list[str]) -> DataFrame:
    """(keys, field, before, after, change) of every field that differs though it is not in ``allowed``.

    change is ADDED or REMOVED where only one side has the row, else CHANGED; with one side's row missing all of its
    fields count, allowed ones too, since no row may come or go.  Keys are unique and not null on either side.
    """
    one = long_fields(before, keys).withColumnRenamed("value", "before").withColumn("_one", F.lit(True))
    two = long_fields(after, keys).withColumnRenamed("value", "after").withColumn("_two", F.lit(True))
    both = one.join(two, [*keys, "field"], "full")
    change = F.when(F.col("_one").isNull(), "ADDED").when(F.col("_two").isNull(), "REMOVED").otherwise("CHANGED")
    told = both.withColumn("change", change).filter(~F.col("before").eqNullSafe(F.col("after")) | (F.col("change") != "CHANGED"))
    return told.filter((F.col("change") != "CHANGED") | ~F.col("field").isin(*allowed)).select(*keys, "field", "before", "after", "change")


def invariants(before: DataFrame, after: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(measure, before, after, same): each measure, an aggregate, over either table; one aggregation a table."""
    values = [F.struct(F.lit(n).alias("measure"), F.col(n).cast("string").alias("value")) for n in measures]
    said = [df.agg(*[m.alias(n) for n, m in measures.items()]).select(F.explode(F.array(*values)).alias("x")).select("x.*") for df in (before, after)]
    joined = said[0].withColumnRenamed("value", "before").join(said[1].withColumnRenamed("value", "after"), "measure")
    return joined.select("measure", "before", "after", F.col("before").eqNullSafe(F.col("after")).alias("same"))


def surface_repair(rows: DataFrame, key: str, column: str, rules: list[tuple[str, str, str]], aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projection, audit): ``column`` repaired by rules and bound to a canonical form where exactly one owns it.

    ``rules``: (name, pattern, replacement), applied in order; ``aliases``: alias, canonical.  The audit has a row for each
    value (key, before, after, action, rules): NORMALIZED if a rule changed it, BOUND if then a canonical form was found,
    AMBIGUOUS if several own it, which binds nothing, else UNCHANGED.  Null stays null.  Only the column changes.
    """
    form = F.col(column)
    steps = rows.select("*", form.alias("_0"))
    for i, (_, pattern, replacement) in enumerate(rules):
        steps = steps.withColumn(f"_{i + 1}", F.regexp_replace(f"_{i}", pattern, replacement))
    fired = F.array_compact(F.array(*[F.when(~F.col(f"_{i}").eqNullSafe(F.col(f"_{i + 1}")), F.lit(name)) for i, (name, _, _) in enumerate(rules)]))
    last = f"_{len(rules)}"
    owners = aliases.groupBy(F.col("alias").alias(last)).agg(F.min("canonical").alias("_canonical"), F.countDistinct("canonical").alias("_owners"))
    bound = steps.withColumn("_fired", fired).join(owners, last, "left")
    one = F.col("_owners") == 1
    after = F.when(one, F.col("_canonical")).otherwise(F.col(last))
    action = F.when(F.col("_owners") > 1, "AMBIGUOUS").when(one & ~F.col("_canonical").eqNullSafe(form), "BOUND").when(F.size("_fired") > 0, "NORMALIZED").otherwise("UNCHANGED")
    projection = bound.select(*[after.alias(c) if c == column else F.col(c) for c in rows.columns])
    return projection, bound.select(key, form.alias("before"), after.alias("after"), action.alias("action"), F.array_join("_fired", ",").alias("rules"))


def p_cell(cell: Column) -> Column:
    """struct(value, comparator) of a cell that is a P value and nothing else; no comparator means equality; (null, NR) otherwise."""
    pattern = r"(?i)^\s*(?:p\s*)?([<>=≤≥]?)\s*([0-9]*\.?[0-9]+(?:e[-+]?[0-9]+)?)\s*$"
    value = F.nullif(F.regexp_extract(cell, pattern, 2), F.lit("")).try_cast("double")
    sign = F.coalesce(F.nullif(F.regexp_extract(cell, pattern, 1), F.lit("")), F.lit("="))
    return F.struct(value.alias("value"), F.when(value.isNotNull(), sign).otherwise("NR").alias("comparator"))


def interval_to(cell: Column) -> Column:
    """struct(lower, upper) of the first "a to b", whatever its case; dashes and commas are no intervals here."""
    pattern = r"(?i)(-?[0-9]+(?:\.[0-9]+)?)\s*to\s*(-?[0-9]+(?:\.[0-9]+)?)"
    bound = lambda k: F.nullif(F.regexp_extract(cell, pattern, k), F.lit("")).try_cast("double")
    return F.struct(bound(1).alias("lower"), bound(2).alias("upper"))
