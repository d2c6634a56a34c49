"""Bookkeeping of requests and runs: what was asked, acknowledged, allowed, left over, and where runs part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.text import strip_part

#: Stages in order, the columns that hold a result's parent in each, and what a first change there is called.
PARENT_STAGES = (
    ("construction", "candidate", "RESULT_CONSTRUCTION", "PARENT_CHANGED_DURING_RESULT_CONSTRUCTION"), ("binding", "construction", "PARENT_BINDING", "PARENT_LOST_DURING_RESULT_CONSTRUCTION"),
    ("merger", "binding", "MERGER", "PARENT_CHANGED_DURING_MERGE"), ("final", "merger", "FINAL_PROJECTION", "WRONG_OUTCOME"),
)


def request_tally(events: DataFrame, stage: str) -> DataFrame:
    """(stage, n): requests by stage."""
    return events.groupBy(stage).agg(F.count("*").alias("n"))


def acknowledged(responses: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, row_ids): every row id in any list of a response, part suffixes aside, sorted."""
    both = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns]))
    return responses.select(key, F.array_sort(F.array_distinct(F.filter(F.transform(both, strip_part), lambda x: x != ""))).alias("row_ids"))


def allowed(requests: DataFrame, plan: DataFrame, digest: str) -> DataFrame:
    """Requests whose digest was planned; no others reach an outside stage."""
    return requests.join(plan.select(digest).distinct(), digest, "left_semi")


def needs_retry(rows: DataFrame, covered: DataFrame, key: str, row: str) -> DataFrame:
    """(key, retry, left): whether, and how many, rows of a key were not covered."""
    left = rows.join(covered.select(key, row).distinct(), [key, row], "left_anti").groupBy(key).agg(F.count("*").alias("left"))
    return rows.select(key).distinct().join(left, key, "left").select(key, F.col("left").isNotNull().alias("retry"), F.coalesce("left", F.lit(0)).alias("left"))


def first_parent_change(available: Column, complete: Column) -> Column:
    """struct(stage, reason): the first stage in which a result's parent changed, by the columns ``<stage>_parent``."""
    said = lambda stage, reason: F.struct(F.lit(stage).alias("stage"), F.lit(reason).alias("reason"))
    out = F.when(~available, said("UNKNOWN", "ARTIFACT_NOT_AVAILABLE")).when(~complete, said("SKILL_EXTRACTION", "PARENT_INCOMPLETE_AT_EXTRACTION"))
    for now, before, stage, reason in PARENT_STAGES:
        out = out.when(~F.col(f"{now}_parent").eqNullSafe(F.col(f"{before}_parent")), said(stage, reason))
    return out.otherwise(said("UNKNOWN", "OTHER"))


def with_priority(rows: DataFrame, priorities: DataFrame, keys: list[str], default: str = "P2") -> DataFrame:
    """``rows`` with the priority that a table (keys, priority) gives them, or the default."""
    return rows.join(priorities.select(*keys, "priority"), keys, "left").withColumn("priority", F.coalesce("priority", F.lit(default)))


def relevant_bindings(bindings: DataFrame, used: DataFrame, field: str) -> DataFrame:
    """Bindings whose field is in use."""
    return bindings.join(used.select(field).distinct(), field, "left_semi")


def field_ids(frames: list[DataFrame], ignored: frozenset[str] = frozenset()) -> list[str]:
    """The names of all fields of some tables, without those to ignore, sorted."""
    return sorted({name for frame in frames for name in frame.schema.fieldNames()} - ignored)


def prior_statuses(rows: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with prior_status and candidates of an earlier run (keys, status, candidates); UNSEEN and none for new ones."""
    earlier = prior.select(*keys, F.col("status").alias("prior_status"), "candidates")
    return rows.join(earlier, keys, "left").withColumns({"prior_status": F.coalesce("prior_status", F.lit("UNSEEN")), "candidates": F.coalesce("candidates", F.array().cast("array<string>"))})
