"""Binding of labels, contrasts and cells to arms; filling and resolving of fields; all answer only where the answer is unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.labels import source_signal
from lumenweave.functions.text import collapse, contrast_sides, strip


def surface(c: Column) -> Column:
    return F.lower(collapse(c))


def alias_index(arms: DataFrame) -> DataFrame:
    """(alias, arm_ids) from arms (arm_id, labels): every label, as compared, with the sorted ids of the arms that have it."""
    long = arms.select("arm_id", F.explode("labels").alias("label")).filter(F.coalesce(strip(F.col("label")), F.lit("")) != "")
    return long.groupBy(surface(F.col("label")).alias("alias")).agg(F.array_sort(F.collect_set("arm_id")).alias("arm_ids"))


def resolve_pairs(rows: DataFrame, index: DataFrame, contrast: str) -> DataFrame:
    """``rows`` with left_id and right_id of a text like "a vs b": null unless both sides name one arm each, and not the same."""
    only = index.filter(F.size("arm_ids") == 1).select("alias", F.get("arm_ids", 0).alias("id"))
    sides = contrast_sides(F.col(contrast))
    out = rows.withColumn("_left", surface(F.get(sides, 0))).withColumn("_right", surface(F.get(sides, 1)))
    for side in ("left", "right"):
        out = out.join(only.select(F.col("alias").alias(f"_{side}"), F.col("id").alias(f"{side}_id")), f"_{side}", "left")
    found = F.col("left_id").isNotNull() & F.col("right_id").isNotNull() & (F.col("left_id") != F.col("right_id"))
    return out.withColumns({f"{s}_id": F.when(found, F.col(f"{s}_id")) for s in ("left", "right")}).drop("_left", "_right")


def definitions(headers: DataFrame, notes: DataFrame, index: DataFrame) -> DataFrame:
    """(table, header, source, quote, left_id, right_id): what a table says its labelled contrasts mean.

    ``headers`` has table and header, ``notes`` table, source and note (captions,
    footnotes).  A header may be a contrast itself, or a note may say "header: a
    vs b"; definitions that do not resolve are kept with null ids, so that a
    second, unreadable one is not overlooked.
    """
    own = resolve_pairs(headers.select("table", "header", F.lit("header").alias("source"), F.col("header").alias("quote"), F.col("header").alias("said")), index, "said").filter("left_id IS NOT NULL")
    pattern = F.concat(F.lit(r"(?i)(?<!\w)\Q"), F.trim("header"), F.lit(r"\E\s*[:=]\s*[^;\n]+"))
    told = headers.join(notes, "table").select("table", "header", "source", F.explode(F.regexp_extract_all("note", pattern, F.lit(0))).alias("quote"))
    told = told.withColumn("said", F.regexp_replace(strip(F.regexp_replace(F.expr("substring(quote, length(trim(header)) + 1)"), r"^\s*[:=]", "")), r"\.+$", ""))
    return own.unionByName(resolve_pairs(told, index, "said")).drop("said")


def bind_scalars(results: DataFrame, cells: DataFrame, defined: DataFrame) -> DataFrame:
    """(result_id, cell) of results (result_id, table, row, left_id, right_id): the one cell of the row under the one header of the same contrast.

    Headers with conflicting or unreadable definitions bind nothing; cells
    (table, row, header, cell) must be unique for their place.
    """
    clear = defined.groupBy("table", "header").agg(F.count_if(F.col("left_id").isNull()).alias("unread"), F.collect_set(F.struct("left_id", "right_id")).alias("pairs"))
    clear = clear.filter((F.col("unread") == 0) & (F.size("pairs") == 1)).select("table", "header", F.col("pairs")[0]["left_id"].alias("left_id"), F.col("pairs")[0]["right_id"].alias("right_id"))
    met = results.join(clear, ["table", "left_id", "right_id"]).join(cells, ["table", "row", "header"])
    return results.select("result_id").join(met.groupBy("result_id").agg(F.when(F.count("*") == 1, F.min("cell")).alias("cell")), "result_id", "left")


def first_hit(candidates: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """(key, value, position) of each key's first candidate that has a value; null where none has."""
    first = F.min(F.when(F.col(value).isNotNull(), F.struct(position, value)))
    return candidates.groupBy(key).agg(first.alias("_f")).select(key, F.col(f"_f.{value}").alias(value), F.col(f"_f.{position}").alias(position))


def overlay(rule: Column, told: Column, valid: Column) -> Column:
    """What an outside source says, where it is valid; else what the rule says."""
    return F.coalesce(F.when(valid, told), rule)


def reconcile(rows: DataFrame, flows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """``rows`` with null columns filled from flows of exactly two arms; ``filled`` lists what was.

    ``columns`` maps a column of ``rows`` to the one of ``flows`` that fills it; flows have ``n_arms``.
    """
    two = flows.filter("n_arms = 2").select(key, *[F.col(c).alias(f"_{c}") for c in columns.values()])
    joined = rows.join(two, key, "left")
    filled = F.array_compact(F.array(*[F.when(F.col(a).isNull() & F.col(f"_{b}").isNotNull(), F.lit(a)) for a, b in columns.items()]))
    return joined.withColumn("filled", filled).withColumns({a: F.coalesce(a, f"_{b}") for a, b in columns.items()}).drop(*[f"_{b}" for b in columns.values()])


def merge_entities(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row an entity: each column's value where its observations agree, ``conflicts`` where not, and how many observations there were."""
    values = [F.collect_set(c).alias(c) for c in columns]
    merged = rows.groupBy(*keys).agg(*values, F.count("*").alias("observations"))
    conflicts = F.array_compact(F.array(*[F.when(F.size(c) > 1, F.lit(c)) for c in columns]))
    return merged.select(*keys, *[F.when(F.size(c) == 1, F.get(c, 0)).alias(c) for c in columns], conflicts.alias("conflicts"), "observations")


def resolve_missing(fields: DataFrame, coverage: DataFrame) -> DataFrame:
    """``fields`` with after_status and reason: what may be said of a field that has no value.

    ``fields``: entity, field, status, value, raw, evidence, candidates and
    applicability (APPLICABLE, NOT_APPLICABLE, UNKNOWN); ``coverage``: entity,
    positive, conflicting and sufficient, of a search of the source.  Only
    unresolved fields change, and not reported needs a sufficient search that
    found nothing.
    """
    said = source_signal(F.col("value"), F.col("evidence"), F.col("candidates"), F.col("raw"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(F.col("status") != "UNRESOLVED", "UNCHANGED")
        .when(F.col("applicability") == "NOT_APPLICABLE", "NOT_APPLICABLE_BY_RESULT_TYPE")
        .when(F.col("applicability") == "UNKNOWN", "APPLICABILITY_UNRESOLVED")
        .when(~no("conflicting"), "CONFLICT_KEEP_UNRESOLVED")
        .when(said | ~no("positive"), "POSITIVE_SOURCE_REQUIRES_EXTRACTION")
        .when(no("sufficient"), "INSUFFICIENT_COVERAGE_KEEP_UNRESOLVED")
        .otherwise("NOT_REPORTED_WITH_SUFFICIENT_COVERAGE")
    )
    after = F.when(reason == "NOT_APPLICABLE_BY_RESULT_TYPE", "NOT_APPLICABLE").when(reason == "NOT_REPORTED_WITH_SUFFICIENT_COVERAGE", "NOT_REPORTED").otherwise(F.col("status"))
    return fields.join(coverage, "entity", "left").withColumn("reason", reason).withColumn("after_status", after).drop("positive", "conflicting", "sufficient")


def bind_sources(records: DataFrame, index: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(records with arm_id, warnings): a record's label bound to the one arm of that name; unknown and ambiguous labels are warned of."""
    bound = records.withColumn("alias", surface(F.col(label))).join(index, "alias", "left")
    n = F.coalesce(F.size("arm_ids"), F.lit(0))
    out = bound.select(*records.columns, F.when(n == 1, F.get("arm_ids", 0)).alias("arm_id"), F.when(n > 1, "AMBIGUOUS_ARM").when(n < 1, "UNKNOWN_ARM").alias("warning"))
    return out.drop("warning"), out.filter("warning IS NOT NULL").select(key, "warning")
