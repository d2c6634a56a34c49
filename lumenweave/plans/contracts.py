"""Queries over contracts, traces of candidates and the summary of a benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import contracts, metrics, traces

from .registry import query

RULES = [
    contracts.allowed("status", "orders", "o_orderstatus", "O", "F"),
    contracts.Check("price", "lineitem", "abs(l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_extendedprice) <= 0.08 * l_extendedprice"),
    contracts.Check("comparator", "lineitem", "l_returnflag = 'N' OR l_linestatus = 'F' OR l_quantity < 40"),
    contracts.Unique("line number", "lineitem", ("l_orderkey", "l_linenumber")),
    contracts.Unique("segment balance", "customer", ("c_nationkey", "c_mktsegment")),
    contracts.Foreign("order", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    contracts.Foreign("customer in credit", "orders", ("o_custkey",), "credit", ("c_custkey",)),
    contracts.Foreign("customer", "orders", ("o_custkey",), "customer", ("c_custkey",)),
    contracts.Foreign("labelled document", "labels", ("doc_id",), "documents", ("doc_id",)),
    contracts.Foreign("labels", "documents", ("doc_id",), "labels", ("doc_id",)),
    contracts.Reciprocal("friends", "customer", "c_custkey", "friends", "customer", "c_custkey", "friends"),
]
IDS = {"orders": "o_orderkey", "lineitem": "id", "customer": "c_custkey", "credit": "c_custkey", "labels": "doc_id", "documents": "doc_id"}


@query("ag07_ag08_contract_violations", """WITH li AS (SELECT *, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS id FROM lineitem), fr AS (SELECT c_custkey, c_custkey + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE -1 END AS f FROM customer)
SELECT DISTINCT * FROM (SELECT 'status' AS rule, o_orderkey::VARCHAR AS id FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT 'price', id FROM li WHERE NOT abs(l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_extendedprice) <= 8e-2 * l_extendedprice
UNION ALL SELECT 'comparator', id FROM li WHERE NOT (l_returnflag = 'N' OR l_linestatus = 'F' OR l_quantity < 40)
UNION ALL SELECT 'line number', l_orderkey || '/' || l_linenumber FROM li GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'segment balance', c_nationkey || '/' || c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1
UNION ALL SELECT 'order', id FROM li WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'customer in credit', o_orderkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'customer', o_orderkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'labelled document', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'labels', doc_id::VARCHAR FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'friends', c_custkey::VARCHAR FROM fr a WHERE NOT EXISTS (SELECT 1 FROM fr b WHERE b.c_custkey = a.f AND b.f = a.c_custkey))""")
def contract_violations(t):
    """Allowed values, tolerances, unique keys, foreign keys and mutual references over six tables, each read once."""
    customer = t.customer.withColumn("friends", F.array(F.col("c_custkey") + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(-1)))
    lineitem = t.lineitem.withColumn("id", F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]))
    tables = {"orders": t.orders, "lineitem": lineitem, "customer": customer, "credit": customer.filter("c_acctbal > 0"), "labels": t.labels, "documents": t.documents}
    return contracts.violations(tables, IDS, RULES)


KINDS = ("PARENT_ADDED", "ARM_BOUND", "PARENT_REMOVED", "PARENT_REPLACED", "RESULT_MERGED")
TRACES = f"""v AS (SELECT user_id AS candidate, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal, {list(traces.STAGES)}[(event_id % 7 + 1)::INT] AS stage,
CASE event_type WHEN 'view' THEN 'PARENT_ADDED' WHEN 'click' THEN 'ARM_BOUND' WHEN 'error' THEN 'PARENT_REMOVED' ELSE CASE WHEN value > 40 THEN 'PARENT_REPLACED' ELSE 'RESULT_MERGED' END END AS event_type, event_id, CASE WHEN value > 3 THEN 'R' || floor(value / 10)::INT END AS reason_code, value, event_type AS raw FROM events),
s AS (SELECT candidate, stage, CASE WHEN max(value) > 45 THEN 'AVAILABLE' ELSE 'NOT_AVAILABLE' END AS availability FROM v GROUP BY candidate, stage)"""


def _traces(t):
    kind = F.when(F.col("event_type") == "view", "PARENT_ADDED").when(F.col("event_type") == "click", "ARM_BOUND").when(F.col("event_type") == "error", "PARENT_REMOVED").otherwise(F.when(F.col("value") > 40, "PARENT_REPLACED").otherwise("RESULT_MERGED"))
    from pyspark.sql import Window

    v = t.events.select(
        F.col("user_id").alias("candidate"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ordinal"),
        F.get(F.array(*map(F.lit, traces.STAGES)), (F.col("event_id") % 7).cast("int")).alias("stage"), kind.alias("event_type"), "event_id",
        F.when(F.col("value") > 3, F.concat(F.lit("R"), F.floor(F.col("value") / 10).cast("string"))).alias("reason_code"), "value", F.col("event_type").alias("raw"),
    )
    s = v.groupBy("candidate", "stage").agg(F.when(F.max("value") > 45, "AVAILABLE").otherwise("NOT_AVAILABLE").alias("availability"))
    return v, s


@query("wn14_pl19_first_failures", f"""WITH {TRACES}, c AS (SELECT candidate, count(*) FILTER (stage <> 'RETRIEVAL' AND availability = 'AVAILABLE') = 6 AS complete, CASE WHEN bool_and(availability = 'AVAILABLE') THEN 'AVAILABLE' WHEN bool_or(availability = 'AVAILABLE') THEN 'PARTIAL' ELSE 'NOT_AVAILABLE' END AS trace FROM s GROUP BY candidate),
f AS (SELECT * FROM v WHERE event_type IN ('PARENT_REMOVED', 'PARENT_REPLACED') AND stage <> 'RETRIEVAL' QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY list_position({list(traces.STAGES)}, stage), ordinal) = 1)
SELECT c.candidate, CASE WHEN complete AND f.candidate IS NOT NULL THEN stage ELSE 'UNKNOWN' END AS first_failure_stage, CASE WHEN complete THEN event_id END AS first_failure_event,
CASE WHEN NOT complete THEN 'ARTIFACT_NOT_AVAILABLE' ELSE coalesce(reason_code, 'OTHER') END AS root_cause, CASE WHEN complete THEN 'COMPLETE' ELSE 'PARTIAL' END AS trace_completeness, trace FROM c LEFT JOIN f USING (candidate)""")
def first_failures(t):
    """Users as candidates: the first event that took or changed a parent, where all stages left a trace, and the roll-up of traces."""
    v, s = _traces(t)
    return traces.first_failures(s, v).join(traces.availability(s), "candidate")


@query("wn16_wn18_stage_classes", f"""WITH {TRACES}, c AS (SELECT candidate, CASE candidate % 9 WHEN 0 THEN 'NONE' ELSE 'COMPLETE' END AS completeness, ['view', 'click', 'error'][(candidate % 3 + 1)::INT] AS eo, min_by(raw, ordinal) AS ro, max_by(raw, ordinal) AS fo,
  CASE WHEN candidate % 4 > 0 THEN (candidate % 2)::VARCHAR END AS ea, (min_by(event_id, ordinal) % 2)::VARCHAR AS ra, (max_by(event_id, ordinal) % 2)::VARCHAR AS fa, ' T ' || candidate % 2 AS et, CASE WHEN candidate % 5 > 0 THEN 't  ' || candidate % 2 END AS rt, 't ' || max(event_id) % 2 AS ft FROM v GROUP BY candidate),
w AS (SELECT c.*, CASE WHEN eo <> ro THEN 'OUTCOME_SPLIT' WHEN ea <> ra THEN 'ARM_WRONG_AT_EXTRACTION' END AS x, coalesce(eo <> fo, false) AS wo, coalesce(ea <> fa, false) AS wa, coalesce(trim(lower(et)) <> ft, false) AS wt FROM c),
e AS (SELECT candidate, arg_min(event_id, ordinal) FILTER (event_type = 'RESULT_MERGED') AS m, arg_min(event_id, ordinal) FILTER (event_type = 'ARM_BOUND') AS b, arg_min(event_id, ordinal) FILTER (event_type = 'PARENT_ADDED') AS a,
  arg_min(event_id, ordinal) FILTER (stage = 'SKILL_EXTRACTION') AS s1, arg_min(event_id, ordinal) FILTER (stage = 'PARENT_BINDING') AS s2, arg_min(event_id, ordinal) FILTER (stage = 'RESULT_CONSTRUCTION') AS s3, arg_min(event_id, ordinal) FILTER (stage = 'MERGER' OR event_type = 'RESULT_MERGED') AS s4 FROM v GROUP BY candidate),
k AS (SELECT *, CASE WHEN completeness = 'NONE' OR NOT (wo OR wa OR wt) THEN 'UNKNOWN' WHEN x IS NOT NULL THEN 'SKILL_EXTRACTION' WHEN m IS NOT NULL THEN 'MERGER' WHEN b IS NOT NULL THEN 'PARENT_BINDING' WHEN a IS NOT NULL THEN 'RESULT_CONSTRUCTION' ELSE 'UNKNOWN' END AS stage FROM w JOIN e USING (candidate))
SELECT candidate, stage, CASE stage WHEN 'SKILL_EXTRACTION' THEN s1 WHEN 'MERGER' THEN s4 WHEN 'PARENT_BINDING' THEN s2 WHEN 'RESULT_CONSTRUCTION' THEN s3 END AS event_id,
CASE stage WHEN 'SKILL_EXTRACTION' THEN x WHEN 'MERGER' THEN CASE WHEN wt THEN 'TIMEPOINT_MERGE_COLLISION' ELSE 'RESULT_COLLISION' END WHEN 'PARENT_BINDING' THEN CASE WHEN wa THEN 'ARM_REBOUND' WHEN wt THEN 'TIMEPOINT_REBOUND' ELSE 'UNKNOWN' END WHEN 'RESULT_CONSTRUCTION' THEN 'RESULT_COLLISION' ELSE 'UNKNOWN' END AS root_cause,
CASE WHEN completeness = 'NONE' THEN 'trace artifact incomplete' WHEN NOT (wo OR wa OR wt) THEN 'no attachment mismatch proven' ELSE 'stage mismatch is supported by the trace' END AS reason FROM k""")
def stage_classes(t):
    """Users as candidates whose expected, extracted and final attachments differ: which stage did it."""
    v, _ = _traces(t)
    text = lambda c: c.cast("string")
    name, first, last = F.col("candidate"), lambda c: F.min_by(c, "ordinal"), lambda c: F.max_by(c, "ordinal")
    c = v.groupBy("candidate").agg(first("raw").alias("raw_outcome"), last("raw").alias("final_outcome"), text(first("event_id") % 2).alias("raw_arm"), text(last("event_id") % 2).alias("final_arm"), (F.max("event_id") % 2).alias("odd"))
    c = c.select(
        "candidate", F.when(name % 9 == 0, "NONE").otherwise("COMPLETE").alias("completeness"), F.get(F.array(*map(F.lit, ("view", "click", "error"))), (name % 3).cast("int")).alias("expected_outcome"), "raw_outcome", "final_outcome",
        F.when(name % 4 > 0, text(name % 2)).alias("expected_arm"), "raw_arm", "final_arm", F.concat(F.lit(" T "), text(name % 2)).alias("expected_timepoint"), F.when(name % 5 > 0, F.concat(F.lit("t  "), text(name % 2))).alias("raw_timepoint"),
        F.concat(F.lit("t "), text(F.col("odd"))).alias("final_timepoint"), *[F.lit(None).cast("string").alias(f"{side}_comparison") for side in ("expected", "raw", "final")],
    )
    return traces.stage_classes(c, v)


CLASSES = ("EXACT", "VALUE_WRONG", "STATUS_WRONG", "FALSE_NR", "NOT_EXTRACTED", "ENTITY_MISSING", "SOURCE_CONFLICT_MISSED")
FIELDS = f"""f AS (SELECT ['Arm', 'Outcome', 'Comparison'][(l_orderkey % 3 + 1)::INT] AS kind, {list(CLASSES)}[(l_suppkey % 7 + 1)::INT] AS classification, ['PRESENT', 'NOT_REPORTED', 'REVIEW_REQUIRED', 'SOURCE_CONFLICT'][(l_partkey % 4 + 1)::INT] AS gold_status, l_quantity > 10 AS matched, 'field' || l_linenumber AS field FROM lineitem),
g AS (SELECT *, CASE WHEN gold_status IN ('PRESENT', 'NOT_REPORTED', 'NOT_APPLICABLE') THEN CASE classification WHEN 'EXACT' THEN 'exact' WHEN 'VALUE_WRONG' THEN 'wrong_value' WHEN 'STATUS_WRONG' THEN 'wrong_status' WHEN 'FALSE_NR' THEN 'wrong_status' WHEN 'NOT_EXTRACTED' THEN 'not_extracted' WHEN 'ENTITY_MISSING' THEN 'entity_missing_cascade' END END AS layer,
  CASE classification WHEN 'ENTITY_MISSING' THEN CASE WHEN NOT matched THEN 'STRUCTURE' END WHEN 'VALUE_WRONG' THEN 'VALUE' WHEN 'STATUS_WRONG' THEN 'STATUS' WHEN 'FALSE_NR' THEN 'STATUS' WHEN 'NOT_EXTRACTED' THEN 'COVERAGE' WHEN 'SOURCE_CONFLICT_MISSED' THEN 'CONFLICT' END AS root, CASE WHEN matched AND classification = 'NOT_EXTRACTED' THEN field END AS abstained FROM f WHERE gold_status <> 'REVIEW_REQUIRED')"""


@query("ag28_benchmark_summary", f"""WITH {FIELDS}, a AS (SELECT grouping(kind, layer) AS gl, grouping(root) AS gr, grouping(abstained) AS ga, kind, layer, root, abstained, count(*) AS n FROM g GROUP BY GROUPING SETS ((kind, layer), (kind), (root), (abstained))),
z AS (SELECT 'layer' AS section, kind AS a, layer AS b FROM (SELECT unnest(['Arm', 'Outcome', 'Comparison', 'ArmResult']) AS kind), (SELECT unnest(['exact', 'wrong_value', 'wrong_status', 'not_extracted', 'entity_missing_cascade']) AS layer)
  UNION ALL SELECT 'targets', unnest(['Arm', 'Outcome', 'Comparison', 'ArmResult']), NULL UNION ALL SELECT 'root', unnest(['STRUCTURE', 'COVERAGE', 'VALUE', 'STATUS', 'CONFLICT', 'EVIDENCE']), NULL),
y AS (SELECT CASE WHEN ga = 0 THEN 'abstained' WHEN gr = 0 THEN 'root' WHEN gl = 0 THEN 'layer' ELSE 'targets' END AS section, coalesce(kind, root, abstained) AS a, layer AS b, n FROM a WHERE (gl <> 0 OR layer IS NOT NULL) AND (gr <> 0 OR root IS NOT NULL) AND (ga <> 0 OR abstained IS NOT NULL))
SELECT section, a, b, sum(n)::BIGINT AS n FROM (SELECT * FROM y UNION ALL SELECT section, a, b, 0 FROM z) GROUP BY section, a, b""")
def benchmark_summary(t):
    """Line items as judged fields: losses by kind and layer, by root cause, abstentions by field; what never occurs counts 0."""
    pick = lambda values, c: F.get(F.array(*map(F.lit, values)), (F.col(c) % len(values)).cast("int"))
    fields = t.lineitem.select(
        pick(("Arm", "Outcome", "Comparison"), "l_orderkey").alias("kind"), pick(CLASSES, "l_suppkey").alias("classification"), pick(("PRESENT", "NOT_REPORTED", "REVIEW_REQUIRED", "SOURCE_CONFLICT"), "l_partkey").alias("gold_status"),
        (F.col("l_quantity") > 10).alias("matched"), F.concat(F.lit("field"), F.col("l_linenumber").cast("string")).alias("field"),
    )
    return metrics.benchmark_summary(fields, ["Arm", "Outcome", "Comparison", "ArmResult"])
