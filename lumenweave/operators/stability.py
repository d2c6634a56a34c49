"""How far repeated runs agree: values by slot, contracts, the first layer that differs; findings by the end of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.operators.traces import plain


def value_stability(rows: DataFrame, runs: list[str]) -> DataFrame:
    """(slot, category) of ``rows`` (slot, run, ord, value, statistic, raw); of a run's rows of a slot the last by ord counts.

    MISSING_IN_ONE_RUN if a run lacks the slot, or some runs have a value and others none; SAME_VALUE if value, statistic
    and raw text agree as they are compared; REPRESENTATION_ONLY_DIFFERENCE if the values do; else DIFFERENT_VALUE.
    """
    last = rows.groupBy("slot", "run").agg(F.max_by(F.struct("value", "statistic", "raw"), "ord").alias("x"))
    said = lambda c: F.coalesce(plain(F.col(f"x.{c}").cast("string")), F.lit(""))
    # One of each, or the least and the most differ.
    differ = [F.min(said(c)) != F.max(said(c)) for c in ("value", "statistic", "raw")]
    some, none = F.count("x.value") > 0, F.count("x.value") < F.count("*")
    category = (
        F.when((F.countDistinct("run") < len(runs)) | (some & none), "MISSING_IN_ONE_RUN").when(differ[0], "DIFFERENT_VALUE")
        .when(differ[1] | differ[2], "REPRESENTATION_ONLY_DIFFERENCE").otherwise("SAME_VALUE")
    )
    return last.filter(F.col("run").isin(*runs)).groupBy("slot").agg(category.alias("category"))


def contract_class(rows: DataFrame, group: str, critical: list[str]) -> DataFrame:
    """(group, drift) of ``rows`` (group, key, status) by the critical keys alone.

    RUN_CONTRACT_DRIFT if one is DIFFERENT; else CONTRACT_NOT_PROVABLE if one is missing, unknown or NOT_AVAILABLE; else
    what differs between the runs is chance.
    """
    counts = rows.filter(F.col("key").isin(*critical)).groupBy(group).agg(
        F.coalesce(F.bool_or(F.col("status") == "DIFFERENT"), F.lit(False)).alias("different"),
        F.countDistinct(F.when(F.col("status").isNotNull() & (F.col("status") != "NOT_AVAILABLE"), F.col("key"))).alias("known"),
        F.bool_or(F.col("status").isNull() | (F.col("status") == "NOT_AVAILABLE")).alias("unknown"),
    )
    every = rows.select(group).distinct().join(counts, group, "left")
    drift = F.when(F.col("different"), "RUN_CONTRACT_DRIFT").when(F.coalesce("unknown", F.lit(True)) | (F.col("known") < len(critical)), "CONTRACT_NOT_PROVABLE").otherwise("STOCHASTIC_LLM_DRIFT")
    return every.select(group, drift.alias("drift"))


#: The layers of a run in order, and what a first difference in each is called.
LAYER_DRIFT = {
    "parser_output": "parser drift", "retrieval_context": "retrieval/context drift", "skill_raw_output": "LLM Skill raw-output variance", "candidate_count": "construction/merger or downstream variance",
    "result_counts": "construction/merger or downstream variance", "final_prediction": "construction/merger or downstream variance",
}


def first_differences(rows: DataFrame, group: str, baseline: str) -> DataFrame:
    """(group, run, first_difference): the first layer in which a run differs from the baseline run, or NONE.

    ``rows``: group, run, layer, digest.  A layer that only one of the two runs has differs.
    """
    rank = F.array_position(F.array(*map(F.lit, LAYER_DRIFT)), F.col("layer"))
    told = rows.filter(F.col("layer").isin(*LAYER_DRIFT)).withColumn("rank", rank)
    base = told.filter(F.col("run") == baseline).select(group, "layer", "rank", F.col("digest").alias("base"), F.lit(True).alias("in_base"))
    runs = told.filter(F.col("run") != baseline).select(group, "run").distinct()
    # The baseline's layers for every other run, beside that run's own.
    wanted = runs.join(base, group).select(group, "run", "layer", "rank", "base", "in_base")
    own = told.filter(F.col("run") != baseline).select(group, "run", "layer", "rank", "digest", F.lit(True).alias("in_run"))
    both = own.join(wanted, [group, "run", "layer", "rank"], "full")
    differs = F.col("in_run").isNull() | F.col("in_base").isNull() | ~F.col("digest").eqNullSafe(F.col("base"))
    return both.groupBy(group, "run").agg(F.coalesce(F.min_by("layer", F.when(differs, F.col("rank"))), F.lit("NONE")).alias("first_difference"))


def drift_of(differences: DataFrame, group: str) -> DataFrame:
    """(group, interpretation): by the earliest layer in which any run differs."""
    rank = F.array_position(F.array(*map(F.lit, LAYER_DRIFT)), F.col("first_difference"))
    first = differences.groupBy(group).agg(F.min_by("first_difference", F.when(F.col("first_difference") != "NONE", rank)).alias("layer"))
    named = F.coalesce(*[F.when(F.col("layer") == n, d) for n, d in LAYER_DRIFT.items()], F.lit("no observed drift in compared layers"))
    return first.select(group, named.alias("interpretation"))


def suffix_matches(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, finding) of each path: the first finding (field, ord, finding) whose field is the path, its leaf or its end after a dot; null without.

    A path is looked up by each of its ends, of which there are as many as it has parts; findings meet it by equality,
    whatever their number.
    """
    named = findings.withColumn("field", F.trim("field")).filter("field <> ''").groupBy("field").agg(F.min(F.struct("ord", "finding")).alias("first"))
    parts = F.split("path", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    leaf = F.substring_index(F.element_at(parts, -1), "[", 1)
    distinct = paths.select("path").distinct()
    asked = distinct.select("path", F.explode(F.array_distinct(F.array_append(ends, leaf))).alias("field"))
    found = asked.join(named, "field").groupBy("path").agg(F.min("first").alias("first"))
    return distinct.join(found, "path", "left").select("path", F.col("first.finding").alias("finding"))
