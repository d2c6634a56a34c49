"""Queries over joins that answer only where the answer is unique, integrity and coverage audits, merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenweave.functions import text
from lumenweave.operators import graph, matching, merging

from .registry import query

EDGES = """e AS (SELECT DISTINCT 'c' || doc_id AS gold, 's' || md5(text) AS pred FROM documents UNION SELECT DISTINCT 'c' || doc_id, 'l' || source || n_chars FROM documents WHERE lang = 'en')"""


def edges(t):
    """A sparse bipartite graph of documents with their texts and, of English ones, with the source and length that they share."""
    gold = F.concat(F.lit("c"), "doc_id").alias("gold")
    same = t.documents.select(gold, F.concat(F.lit("s"), F.md5("text")).alias("pred"))
    return same.union(t.documents.filter("lang = 'en'").select(gold, F.concat(F.lit("l"), "source", "n_chars"))).distinct()


WALK = f"""WITH RECURSIVE {EDGES},
b AS (SELECT 'g:' || gold AS u, 'p:' || pred AS v FROM e UNION SELECT 'p:' || pred, 'g:' || gold FROM e),
w AS (SELECT u AS node, u AS root FROM b UNION SELECT b.v, w.root FROM w JOIN b ON b.u = w.node),
c AS (SELECT node, min(root) AS component FROM w GROUP BY node)"""


@query("gr01_components", f"{WALK} SELECT node, component FROM c")
def components(t):
    return graph.components(edges(t).select(F.concat(F.lit("g:"), "gold").alias("u"), F.concat(F.lit("p:"), "pred").alias("v")))


@query("jn01_component_match", f"""{WALK}, z AS (SELECT component, count(*) FILTER (node LIKE 'g:%') AS ng, count(*) FILTER (node LIKE 'p:%') AS np FROM c GROUP BY component)
SELECT gold, pred, CASE WHEN ng = 1 AND np = 1 THEN 'MATCHED' WHEN ng = 1 THEN 'SPLIT' WHEN np = 1 THEN 'MERGED' ELSE 'AMBIGUOUS' END AS status
FROM e JOIN c ON c.node = 'g:' || gold JOIN z USING (component)""")
def component_match(t):
    return graph.component_shapes(edges(t))


@query("jn07_jn09_unique_safe_links", f"""WITH {EDGES} SELECT gold, pred, safe, count(*) OVER (PARTITION BY gold) = 1 AND count(*) OVER (PARTITION BY pred) = 1 AND safe AS accepted
FROM (SELECT *, length(gold) <= length(pred) AS safe FROM e)""")
def unique_safe_links(t):
    return matching.unique_safe(edges(t).withColumn("safe", F.length("gold") <= F.length("pred")), "gold", "pred", "safe")


@query("gr04_bounded_search", f"""WITH RECURSIVE {EDGES}, b AS (SELECT gold AS u, pred AS v FROM e UNION SELECT pred, gold FROM e),
w AS (SELECT 'c1' AS node, 0 AS depth UNION SELECT 'c7', 0 UNION SELECT v, depth + 1 FROM w JOIN b ON u = node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def bounded_search(t):
    e = edges(t)
    both = e.select(F.col("gold").alias("u"), F.col("pred").alias("v")).union(e.select("pred", "gold"))
    starts = t.region.sparkSession.createDataFrame([("c1",), ("c7",)], "node string")
    return graph.bounded_search(both, starts, 3)


@query("jn13_gr05_perfect_matching")
def perfect_matching(t):
    """Line items of an order to suppliers, by nearby keys: can all be paired off?"""
    # Line numbers may repeat within an order; rows are numbered, which an order's few lines allow.
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    lines = t.lineitem.select("l_orderkey", "l_quantity", F.row_number().over(order).alias("n"))
    pairs = lines.alias("a").join(lines.alias("b"), "l_orderkey").filter("abs(a.l_quantity - b.l_quantity) <= 12 AND a.n <> b.n")
    sizes = lines.groupBy("l_orderkey").agg(F.count("*").alias("n_left"), F.count("*").alias("n_right"))
    return graph.perfect_matching(pairs.select("l_orderkey", F.col("a.n").alias("left"), F.col("b.n").alias("right")), "l_orderkey", sizes)


@query("jn02_jn18_unique_alias", """WITH a AS (SELECT lower(split_part(p_name, ' ', 1)) AS label, p_brand FROM part), o AS (SELECT label, min(p_brand) AS p_brand FROM a GROUP BY label HAVING count(DISTINCT p_brand) = 1)
SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS label, o.p_brand AS bound FROM part LEFT JOIN o ON o.label = lower(split_part(p_name, ' ', 1))""")
def unique_alias(t):
    labelled = t.part.withColumn("label", F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))))
    bound = matching.unique_lookup(labelled.select("p_partkey", "label"), labelled.select("label", F.col("p_brand").alias("bound")), "label", "bound")
    return bound.select("p_partkey", "label", "bound")


@query("jn03_jn04_composite_keys", """SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), '+') || '|' || min(l_shipdate::DATE)::VARCHAR || '|' || max(l_returnflag) AS identity FROM lineitem GROUP BY l_orderkey""")
def composite_keys(t):
    sides = F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), "+")
    return t.lineitem.groupBy("l_orderkey").agg(F.concat_ws("|", sides, F.min(F.to_date("l_shipdate")).cast("string"), F.max("l_returnflag")).alias("identity"))


@query("jn10_first_empty_reason", """SELECT o_orderkey, CASE WHEN NOT coalesce(o_totalprice > 50000, false) THEN 'price' WHEN NOT coalesce(o_orderstatus <> 'F', false) THEN 'status' WHEN NOT coalesce(c_acctbal > 0, false) THEN 'balance' ELSE 'kept' END AS reason
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def first_empty_reason(t):
    both = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    steps = [("price", F.col("o_totalprice") > 50000), ("status", F.col("o_orderstatus") != "F"), ("balance", F.col("c_acctbal") > 0)]
    return both.select("o_orderkey", matching.first_reason(steps, "kept").alias("reason"))


@query("jn16_jn17_integrity", """SELECT 'orders.o_custkey' AS rule, o_custkey::VARCHAR AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 4) GROUP BY 2
UNION ALL SELECT 'lineitem.l_partkey', l_partkey::VARCHAR FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 49) GROUP BY 2
UNION ALL SELECT 'documents.text twice', min(doc_id)::VARCHAR FROM documents GROUP BY md5(text) HAVING count(*) > 1""")
def integrity(t):
    twice = t.documents.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").cast("string").alias("id"), F.count("*").alias("n")).filter("n > 1")
    return (
        matching.violations(t.orders, "o_custkey", t.customer.filter("c_custkey % 10 <> 4"), "c_custkey", "orders.o_custkey")
        .union(matching.violations(t.lineitem, "l_partkey", t.part.filter("p_size < 49"), "p_partkey", "lineitem.l_partkey"))
        .union(twice.select(F.lit("documents.text twice").alias("rule"), "id"))
    )


@query("jn24_unique_cell", """SELECT o_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 1 THEN max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) END AS cell FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def unique_cell(t):
    hit = F.col("l_returnflag") == "R"
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.when(F.count_if(hit) == 1, F.max(F.when(hit, F.col("l_linenumber")))).alias("cell"))


@query("jn33_jn34_fill_and_append", """WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name, c_nationkey AS nation FROM customer),
b AS (SELECT s_suppkey * 20 AS k, s_name AS name, s_nationkey AS nation FROM supplier)
SELECT a.k, coalesce(a.name, b.name) AS name, coalesce(a.nation, b.nation) AS nation FROM a LEFT JOIN b USING (k) UNION ALL SELECT k, name, nation FROM b WHERE k NOT IN (SELECT k FROM a)""")
def fill_and_append(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("nation"))
    b = t.supplier.select((F.col("s_suppkey") * 20).alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return matching.merge_append(a, b, "k", ["name", "nation"])


@query("jn35_cross_source_totals", """SELECT o_orderkey, round(o_totalprice, 2) AS stated, round(sum(l_extendedprice), 2) AS summed, abs(o_totalprice - sum(l_extendedprice)) <= 1 AS consistent FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice""")
def cross_source_totals(t):
    summed = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    both = t.orders.join(summed, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", F.round("o_totalprice", 2).alias("stated"), F.round("s", 2).alias("summed"), (F.abs(F.col("o_totalprice") - F.col("s")) <= 1).alias("consistent"))


@query("jn37_authority_override", """SELECT n_nationkey, coalesce(a.name, n_name) AS n_name, CASE WHEN a.name IS NOT NULL AND a.name IS DISTINCT FROM n_name THEN 'n_name' ELSE '' END AS changed
FROM nation LEFT JOIN (SELECT s_nationkey AS k, max(s_name) AS name FROM supplier WHERE s_acctbal > 8000 GROUP BY s_nationkey) a ON a.k = n_nationkey""")
def authority_override(t):
    told = t.supplier.filter("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_name").alias("n_name"))
    return matching.override(t.nation.select("n_nationkey", "n_name"), told, "n_nationkey", ["n_name"])


@query("jn29_greedy_content_join", """WITH g AS (SELECT doc_id AS gid, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents WHERE doc_id % 2 = 0),
p AS (SELECT doc_id AS pid, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents WHERE doc_id % 2 = 1) SELECT gid, pid FROM g JOIN p USING (h, n)""")
def greedy_content_join(t):
    """Equal contents pair off in id order, each prediction once."""
    order = lambda c: F.row_number().over(Window.partitionBy("h").orderBy(c))
    docs = t.documents.select("doc_id", F.md5("text").alias("h"))
    g = docs.filter("doc_id % 2 = 0").withColumn("n", order("doc_id")).withColumnRenamed("doc_id", "gid")
    p = docs.filter("doc_id % 2 = 1").withColumn("n", order("doc_id")).withColumnRenamed("doc_id", "pid")
    return g.join(p, ["h", "n"]).select("gid", "pid")


@query("jn38_ordered_enrichment", """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN 'account' END, CASE WHEN o.k IS NOT NULL THEN 'orders' END, 'none') AS found_in FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 100000) o ON o.k = c_custkey""")
def ordered_enrichment(t):
    o = t.orders.filter("o_totalprice > 100000").select(F.col("o_custkey").alias("k")).distinct()
    return t.customer.join(o, F.col("k") == F.col("c_custkey"), "left").select("c_custkey", F.when(F.col("c_acctbal") > 5000, "account").when(F.col("k").isNotNull(), "orders").otherwise("none").alias("found_in"))


@query("jn43_three_way_status", """SELECT p_partkey, CASE WHEN f.k IS NOT NULL THEN 'finding' WHEN l.k IS NULL THEN 'missing' ELSE 'acceptable' END AS status FROM part
LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 95e-3 AND l_quantity > 45) f ON f.k = p_partkey LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') l ON l.k = p_partkey""")
def three_way_status(t):
    f = t.lineitem.filter((F.col("l_discount") > 0.095) & (F.col("l_quantity") > 45)).select(F.col("l_partkey").alias("f")).distinct()
    l = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("l")).distinct()
    both = t.part.join(f, F.col("f") == F.col("p_partkey"), "left").join(l, F.col("l") == F.col("p_partkey"), "left")
    return both.select("p_partkey", F.when(F.col("f").isNotNull(), "finding").when(F.col("l").isNull(), "missing").otherwise("acceptable").alias("status"))


@query("jn44_suffix_paths", """SELECT url, CASE WHEN url LIKE '%/' || leaf THEN leaf END AS leaf FROM (SELECT url, regexp_extract(url, '([^/]+)$', 1) AS leaf FROM pages)""")
def suffix_paths(t):
    leaf = F.regexp_extract("url", "([^/]+)$", 1)
    return t.pages.select("url", F.when(F.col("url").endswith(F.concat(F.lit("/"), leaf)), leaf).alias("leaf"))


@query("ag07_quality_rules", """SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN l_quantity < 1 THEN 'quantity' END, CASE WHEN l_discount > 9e-2 THEN 'discount' END, CASE WHEN abs(l_tax - l_discount) < 1e-3 THEN 'tax is discount' END]) AS rule FROM lineitem) WHERE rule IS NOT NULL GROUP BY rule""")
def quality_rules(t):
    fired = F.array(F.when(F.col("l_quantity") < 1, "quantity"), F.when(F.col("l_discount") > 0.09, "discount"), F.when(F.abs(F.col("l_tax") - F.col("l_discount")) < 0.001, "tax is discount"))
    return t.lineitem.select(F.explode(F.array_compact(fired)).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("ag19_ag30_coverage_audit", """WITH r AS (SELECT o_orderkey AS k FROM orders), c AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01' GROUP BY 1)
SELECT count(*) AS requested, count(c.k) AS covered, count(*) FILTER (c.k IS NULL) AS missing, count(*) FILTER (c.n > 1) AS repeated, CASE WHEN count(*) FILTER (c.k IS NULL) = 0 THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM r LEFT JOIN c USING (k)""")
def coverage_audit(t):
    covered = t.lineitem.filter(F.col("l_shipdate") >= F.lit("1995-06-01").cast("timestamp")).groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    both = t.orders.join(covered, F.col("o_orderkey") == F.col("k"), "left")
    missing = F.count_if(F.col("k").isNull())
    return both.agg(F.count("*").alias("requested"), F.count("k").alias("covered"), missing.alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"), F.when(missing == 0, "PASS").otherwise("REVIEW").alias("verdict"))


@query("ag14_contradictions", """SELECT user_id, ts::DATE AS day, count(*) AS n, CASE WHEN count(DISTINCT round(value, 1)) > 1 THEN 'conflict' ELSE 'unresolved' END AS kind FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts::DATE HAVING count(*) >= 2""")
def contradictions(t):
    """Claims of one user and day: two or more rows, in conflict if their values differ; no winner is named."""
    rows = t.events.filter("event_type = 'purchase'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct(F.round("value", 1)).alias("v"))
    return rows.filter("n >= 2").select("user_id", "day", "n", F.when(F.col("v") > 1, "conflict").otherwise("unresolved").alias("kind"))


@query("ag15_ag16_conflict_merge", """WITH o AS (SELECT user_id, event_type, CASE WHEN event_id % 5 = 0 THEN 'NOT_REPORTED' WHEN event_id % 7 = 0 THEN 'NOT_APPLICABLE' ELSE 'PRESENT' END AS status, floor(value / 40)::BIGINT::VARCHAR AS value FROM events)
SELECT user_id, event_type, CASE n WHEN 0 THEN CASE WHEN lo = hi THEN lo ELSE 'REVIEW_REQUIRED' END WHEN 1 THEN 'PRESENT' ELSE 'SOURCE_CONFLICT' END AS status, CASE WHEN n = 1 THEN v END AS value, n AS n_candidates, coalesce(c, '') AS candidates
FROM (SELECT user_id, event_type, count(DISTINCT value) FILTER (status = 'PRESENT') AS n, min(value) FILTER (status = 'PRESENT') AS v, array_to_string(list_sort(list(DISTINCT value) FILTER (status = 'PRESENT')), '|') AS c,
  min(status) FILTER (status <> 'PRESENT') AS lo, max(status) FILTER (status <> 'PRESENT') AS hi FROM o GROUP BY user_id, event_type)""")
def conflict_merge(t):
    status = F.when(F.col("event_id") % 5 == 0, "NOT_REPORTED").when(F.col("event_id") % 7 == 0, "NOT_APPLICABLE").otherwise("PRESENT")
    rows = t.events.select("user_id", "event_type", status.alias("status"), F.floor(F.col("value") / 40).cast("string").alias("value"))
    return merging.merge_observations(rows, ["user_id", "event_type"], "status", "value").withColumn("candidates", F.array_join("candidates", "|"))


@query("ag11_ag13_wn02_representatives", """SELECT lang, source, doc_id, n_rows, status, selection FROM (SELECT lang, source, doc_id, n_chars, row_number() OVER w AS r, count(*) OVER (PARTITION BY lang, source) AS n_rows,
  CASE WHEN max(n_chars) OVER (PARTITION BY lang, source) - min(n_chars) OVER (PARTITION BY lang, source) > 1e-9 THEN 'conflict' WHEN count(*) OVER (PARTITION BY lang, source) > 1 THEN 'duplicate' ELSE 'single' END AS status,
  CASE WHEN count(*) OVER (PARTITION BY lang, source) = 1 THEN 'single' ELSE 'most_complete' END AS selection FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id)) WHERE r = 1""")
def representatives(t):
    rows = t.documents.select("lang", "source", "doc_id", "n_chars")
    return merging.group_labels(rows, ["lang", "source"], "n_chars", ["n_chars"], ["doc_id"]).select("lang", "source", "doc_id", "n_rows", "status", "selection")


@query("ag12_tolerant_conflicts", """SELECT l_partkey, count(*) AS n, max(l_discount) - min(l_discount) > 5e-2 AS conflict FROM lineitem GROUP BY l_partkey""")
def tolerant_conflicts(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), (F.max("l_discount") - F.min("l_discount") > 0.05).alias("conflict"))


@query("ag17_ordered_distinct", """SELECT user_id, array_to_string(list(event_type ORDER BY f), '>') AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def ordered_distinct(t):
    first = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ">").alias("kinds"))


@query("ag26_group_flags", """SELECT conv_id, count(*) AS n, count(*) > 4 AS repeats, count(*) FILTER (role = 'user') = 0 AS no_user, count(*) FILTER (coalesce(text, '') = '') > 0 AS blank FROM conversations GROUP BY conv_id""")
def group_flags(t):
    return t.conversations.groupBy("conv_id").agg(
        F.count("*").alias("n"), (F.count("*") > 4).alias("repeats"), (F.count_if(F.col("role") == "user") == 0).alias("no_user"), (F.count_if(F.coalesce("text", F.lit("")) == "") > 0).alias("blank")
    )


@query("ag39_dedupe_sum_derive", """SELECT o_custkey, sum(v)::BIGINT AS dropped, max(n) AS randomized, max(n) - sum(v)::BIGINT AS received FROM (SELECT DISTINCT o_custkey, o_orderpriority, o_orderkey % 5 AS v FROM orders) JOIN (SELECT o_custkey, count(*) * 10 AS n FROM orders GROUP BY o_custkey) USING (o_custkey) GROUP BY o_custkey""")
def dedupe_sum_derive(t):
    once = t.orders.select("o_custkey", "o_orderpriority", (F.col("o_orderkey") % 5).alias("v")).distinct().groupBy("o_custkey").agg(F.sum("v").alias("dropped"))
    n = t.orders.groupBy("o_custkey").agg((F.count("*") * 10).alias("randomized"))
    return once.join(n, "o_custkey").withColumn("received", F.col("randomized") - F.col("dropped"))


@query("sk02_upsert", """SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT p_partkey, 'new', p_size + 1 FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey + 1000000, 'new', p_size + 1 FROM part WHERE p_partkey % 10 = 0""")
def upsert(t):
    rows = t.part.select("p_partkey", "p_brand", "p_size")
    fresh = rows.filter("p_partkey % 10 = 0").withColumn("p_brand", F.lit("new")).withColumn("p_size", F.col("p_size") + 1)
    return merging.upsert(rows, fresh.union(fresh.withColumn("p_partkey", F.col("p_partkey") + 1000000)), ["p_partkey"])


@query("sk14_append_with_remap", """SELECT 'n' || n_nationkey AS id, n_name AS body FROM nation UNION ALL SELECT 'n' || (n_nationkey + 50), n_name FROM nation UNION ALL
SELECT 'n' || n_nationkey || '-retry-01', 'other' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'n' || n_nationkey || '-retry-02', 'zzz' FROM nation WHERE n_nationkey % 2 = 0""")
def append_with_remap(t):
    rows = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("body"))
    even = t.nation.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    incoming = rows.union(t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey") + 50).alias("id"), F.col("n_name").alias("body")))
    incoming = incoming.union(even.withColumn("body", F.lit("other"))).union(even.withColumn("body", F.lit("zzz")))
    return merging.append_only(rows, incoming, "id", ["body"])


@query("gr02_duplicate_hints", """WITH RECURSIVE h AS (SELECT doc_id AS id, md5(text) AS a, source || '/' || n_chars AS b FROM documents WHERE n_chars > 0),
e AS (SELECT DISTINCT x.id AS u, y.id AS v FROM h x JOIN (SELECT a, min(id) AS id FROM h GROUP BY a) y USING (a) UNION SELECT DISTINCT x.id, y.id FROM h x JOIN (SELECT b, min(id) AS id FROM h GROUP BY b) y USING (b)),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e), w AS (SELECT u AS node, u AS root FROM s UNION SELECT s.v, w.root FROM w JOIN s ON s.u = w.node) SELECT node, min(root) AS component FROM w GROUP BY node""")
def duplicate_hints(t):
    """Documents of equal text, or of equal source and length, fall together; hints are stars around the least id."""
    h = t.documents.filter("n_chars > 0").select(F.col("doc_id").alias("u"), F.md5("text").alias("a"), F.concat_ws("/", "source", F.col("n_chars").cast("string")).alias("b"))
    star = lambda c: h.join(h.groupBy(c).agg(F.min("u").alias("v")), c).select("u", "v")
    return graph.components(star("a").union(star("b")))
