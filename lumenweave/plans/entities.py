"""The queries that match two graphs over the driver's tables, kind by kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.text import collapse
from lumenweave.operators.entities import entity, match_entities, ref

from .registry import query


def _level(kind: str, gold: str, pred: str) -> str:
    """A kind's part of the SQL: all edges, degrees of ends and neighbours, statuses.  ``gold`` has id, key, method and ``pred`` id, key, reason."""
    k = kind.lower()
    split = "WHEN mp = 1 THEN 'SPLIT' WHEN mg = 1 THEN 'MERGED'" if kind == "Outcome" else ""
    why = "CASE status WHEN 'AMBIGUOUS' THEN 'ENTITY_AMBIGUOUS' WHEN 'SPLIT' THEN 'OUTCOME_IDENTITY_SPLIT' WHEN 'MERGED' THEN 'OUTCOME_IDENTITY_MERGE' END"
    return f"""{k}_g AS ({gold}), {k}_p AS ({pred}),
{k}_e AS (SELECT g.id AS gold_id, p.id AS pred_id, max(method) AS method FROM {k}_g g JOIN {k}_p p USING (key) GROUP BY 1, 2),
{k}_d AS (SELECT *, count(*) OVER (PARTITION BY gold_id) AS dg, count(*) OVER (PARTITION BY pred_id) AS dp FROM {k}_e),
{k}_f AS (SELECT *, max(dp) OVER (PARTITION BY gold_id) AS mp, max(dg) OVER (PARTITION BY pred_id) AS mg FROM {k}_d),
{k}_s AS (SELECT gold_id, pred_id, method, CASE WHEN dg = 1 AND dp = 1 THEN 'MATCHED' {split} ELSE 'AMBIGUOUS' END AS status FROM {k}_f),
{k}_m AS (SELECT pred_id, gold_id FROM {k}_s WHERE status = 'MATCHED'),
{k}_r AS (SELECT '{kind}' AS kind, gold_id, pred_id, status, method, NULL AS reason FROM {k}_s WHERE status = 'MATCHED'
UNION ALL SELECT DISTINCT '{kind}', id, NULL, coalesce(status, 'MISSING'), NULL, coalesce({why}, 'ENTITY_MISSING') FROM {k}_g LEFT JOIN {k}_s ON gold_id = id WHERE status IS NULL OR status <> 'MATCHED'
UNION ALL SELECT DISTINCT '{kind}', NULL, id, coalesce(status, 'EXTRA'), NULL, coalesce({why}, reason, 'ENTITY_EXTRA') FROM {k}_p LEFT JOIN {k}_s ON pred_id = id WHERE status IS NULL OR status <> 'MATCHED')"""


X = "CASE WHEN s_suppkey % 3 = 0 THEN 'S' ELSE 'X' END || s_suppkey"
OTHER = "CASE WHEN (s_suppkey + 1) % 3 = 0 THEN 'S' ELSE 'X' END || (s_suppkey + 1)"
ARM = "'S' || (o_orderkey % 100 + 1)"
X_ARM = "CASE WHEN (o_orderkey % 100 + 1) % 3 = 0 THEN 'S' ELSE 'X' END || (o_orderkey % 100 + 1)"
MONTH = "strftime(o_orderdate, '%Y-%m') || '|' || o_orderpriority"
SQL = "WITH " + ",\n".join([
    _level("Article", "SELECT 'R' || r_regionkey AS id, id AS key, 'EXACT_ID' AS method FROM region", "SELECT CASE WHEN r_regionkey = 4 THEN 'R9' ELSE 'R' || r_regionkey END AS id, id AS key, NULL AS reason FROM region"),
    _level("Study", "SELECT 'N' || n_nationkey AS id, 'R' || n_regionkey || '|' || id AS key, 'EXACT_ID' AS method FROM nation", "SELECT n.id, m.gold_id || '|' || n.id AS key, NULL AS reason FROM (SELECT CASE WHEN n_nationkey % 7 = 3 THEN 'M' ELSE 'N' END || n_nationkey AS id, 'R' || n_regionkey AS article FROM nation) n LEFT JOIN article_m m ON m.pred_id = article"),
    _level("Arm",
        "SELECT 'S' || s_suppkey AS id, 'N' || s_nationkey || '|' || CASE WHEN s_suppkey % 3 = 0 THEN 'id:S' || s_suppkey ELSE 'arm ' || s_suppkey % 4 END AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'EXACT_ID' ELSE 'SEMANTIC_IDENTITY' END AS method FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey || '|short ' || s_suppkey % 4, 'GOLD_ALIAS' FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0",
        f"SELECT {X} AS id, m.gold_id || '|' || CASE WHEN s_suppkey % 3 = 0 THEN 'id:S' || s_suppkey WHEN s_suppkey % 5 = 1 THEN 'short ' || s_suppkey % 4 ELSE 'arm ' || s_suppkey % 4 END AS key, NULL AS reason FROM supplier LEFT JOIN study_m m ON m.pred_id = 'N' || s_nationkey"),
    _level("Outcome",
        "SELECT x || c_custkey AS id, 'N' || c_nationkey || '|' || c_mktsegment || '|outcome ' || c_custkey % 50 AS key, 'SEMANTIC_IDENTITY' AS method FROM customer, (VALUES ('C'), ('G')) v(x) WHERE x = 'C' OR c_custkey % 8 = 5",
        "SELECT x || c_custkey AS id, m.gold_id || '|' || c_mktsegment || '|outcome ' || c_custkey % 50 AS key, NULL AS reason FROM customer CROSS JOIN (VALUES ('C'), ('D')) v(x) LEFT JOIN study_m m ON m.pred_id = 'N' || c_nationkey WHERE c_custkey % 9 <> 4 AND (x = 'C' OR c_custkey % 6 = 0)"),
    _level("Intervention",
        "SELECT 'I' || s_suppkey AS id, 'N' || s_nationkey || '|S' || s_suppkey || CASE WHEN s_suppkey % 4 = 0 THEN '|S' || (s_suppkey + 1) ELSE '' END || '|needle ' || s_suppkey % 2 AS key, 'SEMANTIC_IDENTITY' AS method FROM supplier",
        f"SELECT 'I' || s_suppkey AS id, m.gold_id || '|' || a.gold_id || CASE WHEN s_suppkey % 4 = 0 THEN '|' || b.gold_id ELSE '' END || '|needle ' || s_suppkey % 2 AS key, NULL AS reason FROM supplier LEFT JOIN study_m m ON m.pred_id = 'N' || s_nationkey LEFT JOIN arm_m a ON a.pred_id = {X} LEFT JOIN arm_m b ON b.pred_id = {OTHER}"),
    _level("Comparison",
        "SELECT 'K' || s_suppkey AS id, 'N' || s_nationkey || '|S' || s_suppkey || '|S' || (s_suppkey + 1) || '|between ' || s_suppkey % 3 AS key, 'COMPOSITE_IDENTITY' AS method FROM supplier",
        f"SELECT 'L' || s_suppkey AS id, CASE WHEN s_suppkey % 10 <> 9 THEN m.gold_id || '|' || a.gold_id || '|' || b.gold_id || '|between ' || s_suppkey % 3 END AS key, CASE WHEN s_suppkey % 10 = 9 OR a.gold_id IS NULL OR b.gold_id IS NULL THEN 'COMPARATOR_SCOPE_UNRESOLVED' END AS reason FROM supplier LEFT JOIN study_m m ON m.pred_id = 'N' || s_nationkey LEFT JOIN arm_m a ON a.pred_id = {X} LEFT JOIN arm_m b ON b.pred_id = {OTHER}"),
    _level("ArmResult",
        f"SELECT 'A' || o_orderkey AS id, {ARM} || '|C' || o_custkey || '|' || {MONTH} AS key, 'COMPOSITE_IDENTITY' AS method FROM orders",
        f"SELECT 'B' || o_orderkey AS id, a.gold_id || '|' || c.gold_id || '|' || {MONTH} AS key, CASE WHEN a.gold_id IS NULL THEN 'ARM_BINDING_UNRESOLVED' WHEN c.gold_id IS NULL THEN 'ENTITY_MISSING' END AS reason FROM orders LEFT JOIN arm_m a ON a.pred_id = {X_ARM} LEFT JOIN outcome_m c ON c.pred_id = 'C' || o_custkey"),
    _level("ComparisonResult",
        f"SELECT 'A' || o_orderkey AS id, 'K' || (o_orderkey % 100 + 1) || '|C' || o_custkey || '|' || {MONTH} AS key, 'COMPOSITE_IDENTITY' AS method FROM orders",
        f"SELECT 'B' || o_orderkey AS id, a.gold_id || '|' || c.gold_id || '|' || {MONTH} AS key, CASE WHEN a.gold_id IS NULL THEN 'COMPARATOR_SCOPE_UNRESOLVED' WHEN c.gold_id IS NULL THEN 'ENTITY_MISSING' END AS reason FROM orders LEFT JOIN comparison_m a ON a.pred_id = 'L' || (o_orderkey % 100 + 1) LEFT JOIN outcome_m c ON c.pred_id = 'C' || o_custkey"),
]) + "\n" + " UNION ALL ".join(f"FROM {k}_r" for k in ("article", "study", "arm", "outcome", "intervention", "comparison", "armresult", "comparisonresult"))


def _sides(t) -> tuple[DataFrame, DataFrame]:
    """Regions as articles, nations as studies, suppliers as arms, interventions and comparisons, customers as outcomes, orders as results;
    predicted arms have two kinds of ids, outcomes are doubled on either side or left out, comparisons lose their arms."""
    cat, c = F.concat, F.col
    lit = lambda prefix, x: cat(F.lit(prefix), x.cast("string"))
    arm = lambda s: cat(F.when(s % 3 == 0, "S").otherwise("X"), s.cast("string"))
    s, o = c("s_suppkey"), c("o_orderkey")
    month = cat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("|"), "o_orderpriority")
    study_of = lambda x: ref("Study", lit("N", c(x)))
    label: Column = lit("arm ", s % 4)
    alias = F.when(s % 2 == 0, lit("short ", s % 4))
    said = collapse(F.lower(lit(" Arm   ", s % 4)))

    def outcomes(second: str, wanted: Column) -> DataFrame:
        rows = t.customer.withColumn("x", F.explode(F.array_compact(F.array(F.lit("C"), F.when(wanted, second)))))
        return entity(rows, "Outcome", cat("x", c("c_custkey").cast("string")), [study_of("c_nationkey")], {"SEMANTIC_IDENTITY": lit("outcome ", c("c_custkey") % 50)}, c("c_mktsegment"))

    def results(kind: str, prefix: str, parent: Column) -> DataFrame:
        return entity(t.orders, kind, lit(prefix, o), [parent, ref("Outcome", lit("C", c("o_custkey")), "ENTITY_MISSING")], None, month)

    at = o % 100 + 1
    unbound, unscoped = "ARM_BINDING_UNRESOLVED", "COMPARATOR_SCOPE_UNRESOLVED"
    needle = {"SEMANTIC_IDENTITY": lit("needle ", s % 2)}
    article, nation = lit("R", c("r_regionkey")), lit("N", c("n_nationkey"))
    gold = [
        entity(t.region, "Article", article, [], {"EXACT_ID": article}),
        entity(t.nation, "Study", nation, [ref("Article", lit("R", c("n_regionkey")))], {"EXACT_ID": nation}),
        entity(t.supplier, "Arm", lit("S", s), [study_of("s_nationkey")], {"SEMANTIC_IDENTITY": label, "GOLD_ALIAS": alias}),
        outcomes("G", c("c_custkey") % 8 == 5),
        entity(t.supplier, "Intervention", lit("I", s), [study_of("s_nationkey"), ref("Arm", lit("S", s)), F.when(s % 4 == 0, ref("Arm", lit("S", s + 1)))], needle),
        entity(t.supplier, "Comparison", lit("K", s), [study_of("s_nationkey"), ref("Arm", lit("S", s)), ref("Arm", lit("S", s + 1))], None, lit("between ", s % 3)),
        results("ArmResult", "A", ref("Arm", lit("S", at))),
        results("ComparisonResult", "A", ref("Comparison", lit("K", at))),
    ]
    told = F.when(c("r_regionkey") == 4, "R9").otherwise(article)
    renamed = F.when(c("n_nationkey") % 7 == 3, lit("M", c("n_nationkey"))).otherwise(nation)
    has = s % 10 != 9
    pred = [
        entity(t.region, "Article", told, [], {"EXACT_ID": told}),
        entity(t.nation, "Study", renamed, [ref("Article", lit("R", c("n_regionkey")))], {"EXACT_ID": renamed}),
        entity(t.supplier, "Arm", arm(s), [study_of("s_nationkey")], {"SEMANTIC_IDENTITY": F.when(s % 5 == 1, lit("short ", s % 4)).otherwise(said)}),
        outcomes("D", c("c_custkey") % 6 == 0).filter("substr(id, 2) % 9 <> 4"),
        entity(t.supplier, "Intervention", lit("I", s), [F.when(s % 4 == 0, ref("Arm", arm(s + 1))), study_of("s_nationkey"), ref("Arm", arm(s))], needle),
        entity(t.supplier, "Comparison", lit("L", s), [study_of("s_nationkey"), F.when(has, ref("Arm", arm(s), unscoped)), F.when(has, ref("Arm", arm(s + 1), unscoped))], None, lit("between ", s % 3), F.when(~has, unscoped)),
        results("ArmResult", "B", ref("Arm", arm(at), unbound)),
        results("ComparisonResult", "B", ref("Comparison", lit("L", at), unscoped)),
    ]
    return reduce(DataFrame.unionByName, gold), reduce(DataFrame.unionByName, pred)


@query("jn01_entities_of_eight_kinds", SQL)
def entities_of_eight_kinds(t):
    return match_entities(*_sides(t))
