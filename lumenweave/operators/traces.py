"""Where in a pipeline a candidate was first damaged, told from the events it left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages in order, and the kinds of events that tell what happened to a candidate.
STAGES = ("RETRIEVAL", "SKILL_EXTRACTION", "RESULT_CONSTRUCTION", "PARENT_BINDING", "NORMALIZATION", "MERGER", "FINAL_PROJECTION")
REMOVALS = ("PARENT_REMOVED", "PARENT_REPLACED")
MERGES = ("RESULT_MERGE_PROPOSED", "RESULT_MERGED", "RESULT_DROPPED_AS_DUPLICATE")
BINDINGS = ("ARM_BOUND", "COMPARISON_BOUND", "OUTCOME_BOUND", "TIMEPOINT_BOUND")
#: What of a result's attachment may be wrong, and what that is called when extraction did it and when binding did.
ATTACHMENTS = (
    ("outcome", "OUTCOME_SPLIT", None), ("arm", "ARM_WRONG_AT_EXTRACTION", "ARM_REBOUND"),
    ("timepoint", "TIMEPOINT_WRONG_AT_EXTRACTION", "TIMEPOINT_REBOUND"), ("comparison", "COMPARISON_WRONG_AT_EXTRACTION", "COMPARISON_REBOUND"),
)


def availability(stages: DataFrame) -> DataFrame:
    """(candidate, trace): AVAILABLE if all its stages are, NOT_AVAILABLE if none is, else PARTIAL."""
    there = F.col("availability") == "AVAILABLE"
    return stages.groupBy("candidate").agg(F.when(F.bool_and(there), "AVAILABLE").when(F.bool_or(there), "PARTIAL").otherwise("NOT_AVAILABLE").alias("trace"))


def first_failures(stages: DataFrame, events: DataFrame) -> DataFrame:
    """(candidate, first_failure_stage, first_failure_event, root_cause, trace_completeness).

    ``stages``: candidate, stage, availability; ``events``: candidate, ordinal, stage, event_type, event_id, reason_code.
    Nothing is claimed where a stage other than retrieval left no trace.  Else the first failure is the event that
    removed or replaced a parent in the earliest stage, and in that stage the first.  A candidate is never gathered:
    both sides are aggregates.
    """
    required = STAGES[1:]
    left = F.countDistinct(F.when(F.col("stage").isin(*required) & (F.col("availability") == "AVAILABLE"), F.col("stage"))) == len(required)
    whole = stages.groupBy("candidate").agg(left.alias("complete"))
    rank = F.array_position(F.array(*[F.lit(s) for s in required]), F.col("stage"))
    damage = events.filter(F.col("event_type").isin(*REMOVALS) & F.col("stage").isin(*required))
    first = damage.groupBy("candidate").agg(F.min(F.struct(rank.alias("rank"), "ordinal", "event_id", "stage", "reason_code")).alias("x"))
    every = whole.join(first, "candidate", "left")
    seen = F.col("complete") & F.col("x").isNotNull()
    return every.select(
        "candidate", F.when(seen, F.col("x.stage")).otherwise("UNKNOWN").alias("first_failure_stage"), F.when(seen, F.col("x.event_id")).alias("first_failure_event"),
        F.when(~F.col("complete"), "ARTIFACT_NOT_AVAILABLE").when(seen, F.coalesce("x.reason_code", F.lit("OTHER"))).otherwise("OTHER").alias("root_cause"),
        F.when(F.col("complete"), "COMPLETE").otherwise("PARTIAL").alias("trace_completeness"),
    )


def parent_changes(events: DataFrame) -> DataFrame:
    """(candidate, ordinal, event_id, change): events after which a candidate's parent is another than before: ADDED, REPLACED or REMOVED.

    ``events`` has candidate, ordinal, event_id and parent, the parent as of the event.
    """
    before = F.lag("parent").over(Window.partitionBy("candidate").orderBy("ordinal", "event_id"))
    moved = events.withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col("parent")))
    change = F.when(F.col("before").isNull(), "ADDED").when(F.col("parent").isNull(), "REMOVED").otherwise("REPLACED")
    return moved.select("candidate", "ordinal", "event_id", change.alias("change"))


def plain(value: Column) -> Column:
    """A name as it is compared: runs of anything but letters and digits are one space, case and ends do not count; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(value), r"(?U)[\W_]+", " ")), F.lit(""))


def stage_classes(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """(candidate, stage, event_id, root_cause, reason): where a mismatch of attachment came in.

    ``candidates``: candidate, completeness, and for each attachment expected_, raw_ and final_ (as extracted, as it
    ended).  If the extracted value is known to be wrong, extraction did it; else a merge, if there was one; else a
    binding; else the construction.  The event is the first of that stage.
    """
    names = [n for n, *_ in ATTACHMENTS]
    wrong = lambda n, side: plain(F.col(f"expected_{n}")).isNotNull() & ~plain(F.col(f"expected_{n}")).eqNullSafe(plain(F.col(f"{side}_{n}")))
    extracted = lambda n: wrong(n, "raw") & plain(F.col(f"raw_{n}")).isNotNull()
    first = lambda *kinds: F.min(F.when(F.col("event_type").isin(*kinds), F.struct("ordinal", "event_id")))
    of_stage = lambda stage: F.min(F.when(F.col("stage") == stage, F.struct("ordinal", "event_id")))["event_id"]
    told = events.groupBy("candidate").agg(
        first(*MERGES)["event_id"].alias("merge"), first(*BINDINGS)["event_id"].alias("binding"), first("PARENT_ADDED")["event_id"].alias("added"),
        of_stage("SKILL_EXTRACTION").alias("skill_event"), of_stage("PARENT_BINDING").alias("binding_event"), of_stage("RESULT_CONSTRUCTION").alias("construction_event"),
        F.min(F.when((F.col("stage") == "MERGER") | F.col("event_type").isin(*MERGES), F.struct("ordinal", "event_id")))["event_id"].alias("merge_event"),
    )
    rows = candidates.join(told, "candidate", "left")
    at_extraction = F.coalesce(*[F.when(extracted(n), F.lit(root)) for n, root, _ in ATTACHMENTS])
    at_binding = F.coalesce(*[F.when(wrong(n, "final"), F.lit(root)) for n, root in (("arm", "ARM_REBOUND"), ("comparison", "COMPARISON_REBOUND"), ("timepoint", "TIMEPOINT_REBOUND"))], F.lit("UNKNOWN"))
    broken = F.col("completeness").isin("BROKEN", "UNKNOWN", "NONE")
    some = F.lit(False)
    for n in names:
        some = some | wrong(n, "final")
    open_ = ~broken & some
    stage = (
        F.when(~open_, "UNKNOWN").when(at_extraction.isNotNull(), "SKILL_EXTRACTION").when(F.col("merge").isNotNull(), "MERGER")
        .when(F.col("binding").isNotNull(), "PARENT_BINDING").when(F.col("added").isNotNull(), "RESULT_CONSTRUCTION").otherwise("UNKNOWN")
    )
    rows = rows.withColumn("stage", stage)
    root = (
        F.when(F.col("stage") == "SKILL_EXTRACTION", at_extraction).when(F.col("stage") == "MERGER", F.when(wrong("timepoint", "final"), "TIMEPOINT_MERGE_COLLISION").otherwise("RESULT_COLLISION"))
        .when(F.col("stage") == "PARENT_BINDING", at_binding).when(F.col("stage") == "RESULT_CONSTRUCTION", "RESULT_COLLISION").otherwise("UNKNOWN")
    )
    event = (
        F.when(F.col("stage") == "SKILL_EXTRACTION", F.col("skill_event")).when(F.col("stage") == "MERGER", F.col("merge_event"))
        .when(F.col("stage") == "PARENT_BINDING", F.col("binding_event")).when(F.col("stage") == "RESULT_CONSTRUCTION", F.col("construction_event"))
    )
    reason = F.when(broken, "trace artifact incomplete").when(~some, "no attachment mismatch proven").otherwise("stage mismatch is supported by the trace")
    return rows.select("candidate", "stage", event.alias("event_id"), root.alias("root_cause"), reason.alias("reason"))
