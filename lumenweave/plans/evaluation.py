"""Scoring predictions against gold, and the metrics over it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenweave.functions import numbers, text
from lumenweave.operators import metrics

from .registry import query

GOLD = """
g AS (SELECT l.doc_id, d.lang, d.source, CASE WHEN l.quality = 1 THEN 'PRESENT' ELSE 'NOT_REPORTED' END AS gold_status, l.toxic AS gold_value FROM labels l LEFT JOIN documents d USING (doc_id)),
p AS (SELECT doc_id, CASE WHEN n_chars < 200 THEN 'NOT_REPORTED' WHEN n_chars > 6000 THEN 'UNRESOLVED' ELSE 'PRESENT' END AS pred_status,
  CASE WHEN regexp_matches(lower(text), 'idiot|clown|scum|moron|trash') THEN 1 ELSE 0 END AS pred_value FROM documents WHERE doc_id % 11 <> 3),
f AS (SELECT g.doc_id, g.lang, g.source, gold_status, pred_status,
  CASE WHEN pred_status IS NULL THEN 'ENTITY_MISSING' WHEN pred_status = 'UNRESOLVED' THEN 'NOT_EXTRACTED'
    WHEN gold_status = pred_status AND gold_status <> 'PRESENT' THEN 'EXACT'
    WHEN gold_status = pred_status THEN CASE WHEN gold_value = pred_value THEN 'EXACT' ELSE 'VALUE_WRONG' END
    WHEN pred_status = 'PRESENT' THEN 'FALSE_PRESENT' WHEN pred_status = 'NOT_REPORTED' THEN 'FALSE_NR' ELSE 'STATUS_WRONG' END AS outcome
  FROM g LEFT JOIN p USING (doc_id))"""


def targets(t):
    """One row a gold target: labels as gold, a rule over documents as prediction; some entities are missing on purpose."""
    status = F.when(F.col("n_chars") < 200, "NOT_REPORTED").when(F.col("n_chars") > 6000, "UNRESOLVED").otherwise("PRESENT")
    # Both what a target is grouped by and what is predicted come from one scan, and meet the labels in one join.
    pred = F.when(F.col("doc_id") % 11 != 3, F.struct(status.alias("pred_status"), F.lower("text").rlike("idiot|clown|scum|moron|trash").cast("int").alias("pred_value")))
    docs = t.documents.select("doc_id", "lang", "source", pred.alias("p")).select("doc_id", "lang", "source", "p.*")
    gold = t.labels.select("doc_id", F.when(F.col("quality") == 1, "PRESENT").otherwise("NOT_REPORTED").alias("gold_status"), F.col("toxic").alias("gold_value"))
    joined = gold.join(docs, "doc_id", "left")
    outcome = metrics.classify(F.col("gold_status"), F.col("pred_status"), F.col("gold_value") == F.col("pred_value"))
    return joined.select("doc_id", "lang", "source", "gold_status", "pred_status", outcome.alias("outcome"))


@query("jn12_ag02_target_classification", f"WITH {GOLD} SELECT * FROM f")
def target_classification(t):
    return targets(t)


@query("ag01_ag03_guarded_rates", f"""WITH {GOLD} SELECT lang, count(*) AS n_targets, count(*) FILTER (outcome = 'EXACT') AS n_exact,
  round(count(*) FILTER (outcome = 'EXACT')::DOUBLE / count(*), 9) AS hard_exact,
  round(count(*) FILTER (pred_status = 'PRESENT' AND gold_status = 'PRESENT')::DOUBLE / nullif(count(*) FILTER (gold_status = 'PRESENT'), 0), 9) AS coverage,
  round(count(*) FILTER (outcome = 'EXACT' AND pred_status = 'PRESENT')::DOUBLE / nullif(count(*) FILTER (pred_status = 'PRESENT'), 0), 9) AS value_accuracy,
  round(count(*) FILTER (gold_status = pred_status)::DOUBLE / count(*), 9) AS status_accuracy FROM f GROUP BY lang""")
def guarded_rates(t):
    n = lambda c: F.count_if(c)
    gold, pred, exact = F.col("gold_status"), F.col("pred_status"), F.col("outcome") == "EXACT"
    share = lambda a, b, name: F.round(metrics.rate(a, b), 9).alias(name)
    return targets(t).groupBy("lang").agg(
        F.count("*").alias("n_targets"), n(exact).alias("n_exact"), share(n(exact), F.count("*"), "hard_exact"),
        share(n((pred == "PRESENT") & (gold == "PRESENT")), n(gold == "PRESENT"), "coverage"),
        share(n(exact & (pred == "PRESENT")), n(pred == "PRESENT"), "value_accuracy"), share(n(gold == pred), F.count("*"), "status_accuracy"),
    )


@query("ag05_ag33_failure_buckets", f"""WITH {GOLD} SELECT outcome AS bucket, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM f WHERE outcome <> 'EXACT' GROUP BY outcome""")
def failure_buckets(t):
    return targets(t).filter("outcome <> 'EXACT'").groupBy(F.col("outcome").alias("bucket")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("ag34_ranked_bottlenecks", f"""WITH {GOLD} SELECT outcome, n, row_number() OVER (ORDER BY CASE outcome WHEN 'ENTITY_MISSING' THEN 0 ELSE 1 END, n DESC, outcome) AS rank
  FROM (SELECT outcome, count(*) AS n FROM f WHERE outcome <> 'EXACT' GROUP BY outcome)""")
def ranked_bottlenecks(t):
    counts = targets(t).filter("outcome <> 'EXACT'").groupBy("outcome").agg(F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("outcome") != "ENTITY_MISSING").cast("int"), F.desc("n"), "outcome")
    return counts.withColumn("rank", F.row_number().over(order))  # one row an outcome


@query("ag04_precision_recall", """WITH g AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), p AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT r_name, count(*) FILTER (g.k IS NOT NULL AND p.k IS NOT NULL) AS matched, count(*) FILTER (p.k IS NULL) AS missing, count(*) FILTER (g.k IS NULL) AS extra,
  round(count(*) FILTER (g.k IS NOT NULL AND p.k IS NOT NULL)::DOUBLE / nullif(count(p.k), 0), 9) AS precision_rate,
  round(count(*) FILTER (g.k IS NOT NULL AND p.k IS NOT NULL)::DOUBLE / nullif(count(g.k), 0), 9) AS recall_rate
FROM g FULL JOIN p ON g.k = p.k JOIN nation ON n_nationkey = coalesce(g.k, p.k) JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def precision_recall(t):
    g = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct().withColumn("g", F.lit(1))
    p = t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct().withColumn("p", F.lit(1))
    both = g.join(p, "k", "full").join(t.nation, F.col("k") == F.col("n_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    hit = F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull())
    return both.groupBy("r_name").agg(
        hit.alias("matched"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("g").isNull()).alias("extra"),
        F.round(metrics.rate(hit, F.count("p")), 9).alias("precision_rate"), F.round(metrics.rate(hit, F.count("g")), 9).alias("recall_rate"),
    )


@query("ag21_ag25_weighted_scores", """SELECT c_mktsegment, round(sum(w) / count(w), 9) AS finding_mean, round(100 * (count(*) FILTER (f = 'correct') + 5e-1 * count(*) FILTER (f = 'acceptable'))::DOUBLE / count(*), 6) AS agreement
FROM (SELECT c_mktsegment, f, CASE f WHEN 'correct' THEN 1e0 WHEN 'acceptable' THEN 8e-1 WHEN 'gold_ambiguous' THEN 75e-2 WHEN 'missing' THEN 3e-1 WHEN 'incorrect' THEN 0e0 WHEN 'partially_incorrect' THEN 4e-1 END AS w
  FROM (SELECT c_mktsegment, ['correct', 'acceptable', 'gold_ambiguous', 'missing', 'incorrect', 'partially_incorrect', 'other'][(c_custkey % 7 + 1)::INT] AS f FROM customer)) GROUP BY c_mktsegment""")
def weighted_scores(t):
    order = F.array(*[F.lit(x) for x in (*metrics.FINDING_WEIGHTS, "other")])
    found = t.customer.withColumn("f", F.get(order, (F.col("c_custkey") % 7).cast("int")))
    return found.groupBy("c_mktsegment").agg(
        F.round(F.avg(metrics.weight(F.col("f"), metrics.FINDING_WEIGHTS)), 9).alias("finding_mean"),
        F.round(100 * (F.count_if(F.col("f") == "correct") + F.lit(0.5) * F.count_if(F.col("f") == "acceptable")).cast("double") / F.count("*"), 6).alias("agreement"),
    )


@query("ag31_ag32_grade_counts", """SELECT o_orderpriority, count(*) FILTER (g = 'EXACT') AS exact, count(*) FILTER (g = 'EQUIVALENT') AS equivalent, count(*) FILTER (g = 'MINOR') AS minor,
  count(*) FILTER (g = 'PARTIAL') AS partial, count(*) FILTER (g = 'WRONG') AS wrong
FROM (SELECT o_orderpriority, ['EXACT', 'EQUIVALENT', 'MINOR', 'PARTIAL'][(o_orderkey % 4 + 1)::INT] AS g FROM orders) GROUP BY o_orderpriority""")
def grade_counts(t):
    grades = F.array(*[F.lit(x) for x in list(metrics.GRADE_WEIGHTS)[:4]])
    graded = t.orders.withColumn("g", F.get(grades, (F.col("o_orderkey") % 4).cast("int")))
    return graded.groupBy("o_orderpriority").agg(*metrics.pick_counts(F.col("g"), list(metrics.GRADE_WEIGHTS)))


@query("ag29_ag36_keyword_counts", """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN lower(text) LIKE '%copyright%' OR lower(text) LIKE '%rights reserved%' THEN 'rights' WHEN lower(text) LIKE '%licen%' THEN 'license'
  WHEN lower(text) LIKE '%@%' THEN 'contact' ELSE 'other' END AS bucket FROM documents) GROUP BY bucket""")
def keyword_counts(t):
    rules = [("rights", ["copyright", "rights reserved"]), ("license", ["licen"]), ("contact", ["@"])]
    return t.documents.groupBy(text.keyword_category(F.col("text"), rules).alias("bucket")).agg(F.count("*").alias("n"))


@query("ag08_ag10_unpivot_audit", """SELECT field_id, count(*) AS n, count(*) FILTER (value IS NULL) AS n_null, count(DISTINCT value) AS n_values, CASE field_id WHEN 'p_brand' THEN 'P0' ELSE 'P1' END AS priority FROM (
  SELECT 'p_brand' AS field_id, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part) GROUP BY field_id""")
def unpivot_audit(t):
    long = t.part.select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size")).unpivot("p_partkey", ["p_brand", "p_type", "p_size"], "field_id", "value")
    return long.groupBy("field_id").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"), F.countDistinct("value").alias("n_values")).withColumn(
        "priority", F.when(F.col("field_id") == "p_brand", "P0").otherwise("P1")
    )


@query("so14_nm33_tolerant_comparators", """SELECT l_orderkey, l_linenumber, abs(a - b) <= greatest(1e-6, 2e-2 * greatest(abs(a), abs(b))) AS near, a = b AS same
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_quantity * p_retailprice AS b FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def tolerant_comparators(t):
    both = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * F.col("p_retailprice")).alias("b"))
    return both.select("l_orderkey", "l_linenumber", numbers.within(F.col("a"), F.col("b"), relative=0.02).alias("near"), (F.col("a") == F.col("b")).alias("same"))


@query("so14_list_comparators", """SELECT o_orderkey, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS same_set, a = b AS same_list, list_sort(a) = list_sort(b) AS same_bag
FROM (SELECT l_orderkey AS o_orderkey, list(l_partkey % 7 ORDER BY l_linenumber, l_partkey % 7) AS a, list(l_suppkey % 7 ORDER BY l_linenumber, l_suppkey % 7) AS b FROM lineitem GROUP BY l_orderkey)""")
def list_comparators(t):
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col(c) % 7))), lambda x: x["col2"])
    both = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(listed("l_partkey").alias("a"), listed("l_suppkey").alias("b"))
    s = lambda c: F.array_sort(F.array_distinct(c))
    return both.select("o_orderkey", (s("a") == s("b")).alias("same_set"), (F.col("a") == F.col("b")).alias("same_list"), (F.array_sort("a") == F.array_sort("b")).alias("same_bag"))


@query("ag06_source_summary", f"""WITH {GOLD} SELECT source, count(*) AS n, count(pred_status) AS n_filled, round(count(pred_status)::DOUBLE / count(*), 9) AS fill_rate FROM f GROUP BY source""")
def source_summary(t):
    return targets(t).groupBy("source").agg(F.count("*").alias("n"), F.count("pred_status").alias("n_filled"), F.round(metrics.rate(F.count("pred_status"), F.count("*")), 9).alias("fill_rate"))


@query("ag35_unresolved_missingness", f"WITH {GOLD} SELECT doc_id, source, gold_status FROM f WHERE gold_status = 'NOT_REPORTED' AND pred_status = 'UNRESOLVED'")
def unresolved_missingness(t):
    return targets(t).filter("gold_status = 'NOT_REPORTED' AND pred_status = 'UNRESOLVED'").select("doc_id", "source", "gold_status")


BUCKETS = ["ENTITY_MISSING", "NOT_EXTRACTED", "VALUE_WRONG", "FALSE_PRESENT", "FALSE_NR", "STATUS_WRONG", "SOURCE_CONFLICT_MISSED", "SOURCE_CONFLICT_SPURIOUS", "EVIDENCE_UNGROUNDED"]


@query("ag05_ag33_ag36_all_buckets", f"""WITH {GOLD}, b AS (SELECT unnest({BUCKETS}) AS bucket), i AS (SELECT outcome, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY doc_id) <= 5)
SELECT bucket, (SELECT count(*) FROM f WHERE outcome = bucket) AS n, coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM i WHERE outcome = bucket), '') AS ids FROM b""")
def all_buckets(t):
    """Every kind of failure with its number and first ids, kinds that never occur included."""
    found = metrics.bucket_counts(targets(t), "outcome", BUCKETS, "doc_id")
    return found.select("bucket", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
