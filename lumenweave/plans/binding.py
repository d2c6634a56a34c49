"""Queries over bindings to arms, missing fields, layout, answers and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import answers, binding, layout, metrics

from .labels import pick
from .registry import query

#: Parts as arms: each has its name and its brand with its size for labels; brands repeat, so that some labels are ambiguous.
ARMS = """arms AS (SELECT p_partkey AS arm_id, unnest([p_brand || ' ' || p_size, 'part ' || p_partkey]) AS label FROM part),
index AS (SELECT lower(label) AS alias, list_sort(list(DISTINCT arm_id)) AS arm_ids FROM arms GROUP BY 1),
only_one AS (SELECT alias, arm_ids[1] AS id FROM index WHERE len(arm_ids) = 1)"""


def arm_index(t):
    return binding.alias_index(t.part.select(F.col("p_partkey").alias("arm_id"), F.array(F.concat_ws("  ", "p_brand", "p_size"), F.concat(F.lit(" Part "), "p_partkey"), F.lit(" ")).alias("labels")))


@query("jn21_alias_index", f"WITH {ARMS} SELECT alias, array_to_string(arm_ids, ',') AS arm_ids FROM index")
def alias_index(t):
    return arm_index(t).select("alias", F.array_join(F.transform("arm_ids", lambda x: x.cast("string")), ",").alias("arm_ids"))


@query("jn22_ordered_pairs", f"""WITH {ARMS}, c AS (SELECT p_partkey, lower(p_brand || ' ' || p_size) AS a, 'part ' || (p_partkey - p_partkey % 7) AS b FROM part)
SELECT p_partkey, CASE WHEN x.id <> y.id THEN x.id END AS left_id, CASE WHEN x.id <> y.id THEN y.id END AS right_id FROM c LEFT JOIN only_one x ON x.alias = a LEFT JOIN only_one y ON y.alias = b""")
def ordered_pairs(t):
    said = F.concat(F.col("p_brand"), F.lit(" "), F.col("p_size"), pick("p_partkey", " vs ", " VS. ", " versus "), F.lit("Part "), F.col("p_partkey") - F.col("p_partkey") % 7)
    return binding.resolve_pairs(t.part.select("p_partkey", said.alias("said")), arm_index(t), "said").select("p_partkey", "left_id", "right_id")


def contrast_tables(t):
    """A table an order: header P1 is defined by a footnote, and by a second one in every third; its scalar is the order's price."""
    two = lambda a, b: F.concat(F.lit("Part "), a, F.lit(" vs part "), b)
    a, b = F.col("o_orderkey") % 20, F.col("o_orderkey") % 20 + 1
    note = F.concat(F.lit("Note; P1: "), two(a, b), F.lit(".\nother"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("; p1 = "), two(b, a))).otherwise(""))
    return t.orders.select(F.col("o_orderkey").alias("table"), F.lit("P1").alias("header"), note.alias("note"), a.alias("left_id"), b.alias("right_id"), "o_totalprice")


@query("jn26_contrast_definitions", """SELECT o_orderkey AS "table", 'P1' AS header, 'footnote' AS source, o_orderkey % 20 AS left_id, o_orderkey % 20 + 1 AS right_id FROM orders
UNION ALL SELECT o_orderkey, 'P1', 'footnote', o_orderkey % 20 + 1, o_orderkey % 20 FROM orders WHERE o_orderkey % 3 = 0""")
def contrast_definitions(t):
    made = contrast_tables(t)
    return binding.definitions(made.select("table", "header"), made.select("table", F.lit("footnote").alias("source"), "note"), arm_index(t)).drop("quote")


@query("jn25_bound_scalars", """SELECT o_orderkey AS result_id, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN o_totalprice END AS cell FROM orders""")
def bound_scalars(t):
    """Every fifth result is of another contrast than its table's."""
    made = contrast_tables(t)
    defined = binding.definitions(made.select("table", "header"), made.select("table", F.lit("footnote").alias("source"), "note"), arm_index(t))
    right = F.when(F.col("table") % 5 == 0, F.col("right_id") + 1).otherwise(F.col("right_id"))
    results = made.select(F.col("table").alias("result_id"), "table", F.lit(1).alias("row"), "left_id", right.alias("right_id"))
    return binding.bind_scalars(results, made.select("table", F.lit(1).alias("row"), "header", F.col("o_totalprice").alias("cell")), defined)


@query("jn20_source_bindings", f"""WITH {ARMS}, r AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'part ' || s_suppkey WHEN 1 THEN 'brand#' || (s_suppkey % 25 + 1) || ' 7' ELSE 'nothing' END AS alias FROM supplier)
SELECT s_suppkey, CASE WHEN len(arm_ids) = 1 THEN arm_ids[1] END AS arm_id, CASE WHEN len(arm_ids) > 1 THEN 'AMBIGUOUS_ARM' WHEN arm_ids IS NULL THEN 'UNKNOWN_ARM' END AS warning FROM r LEFT JOIN index USING (alias)""")
def source_bindings(t):
    at = F.col("s_suppkey") % 3
    label = F.when(at == 0, F.concat(F.lit("PART "), "s_suppkey")).when(at == 1, F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25 + 1, F.lit("  7"))).otherwise("nothing")
    bound, warned = binding.bind_sources(t.supplier.select("s_suppkey", label.alias("label")), arm_index(t), "s_suppkey", "label")
    return bound.join(warned, "s_suppkey", "left").select("s_suppkey", "arm_id", "warning")


@query("jn39_first_hits", """SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS value, min(o_orderkey) FILTER (o_orderstatus = 'F') AS position FROM orders GROUP BY o_custkey""")
def first_hits(t):
    told = t.orders.select("o_custkey", F.col("o_orderkey").alias("position"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("value"))
    return binding.first_hit(told, "o_custkey", "position", "value")


@query("jn40_valid_overlays", """SELECT c_custkey, CASE WHEN c_acctbal > 0 AND s_name IS NOT NULL THEN s_name ELSE c_name END AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def valid_overlays(t):
    both = t.customer.join(t.supplier, F.col("s_suppkey") == F.col("c_custkey"), "left")
    return both.select("c_custkey", binding.overlay(F.col("c_name"), F.col("s_name"), F.col("c_acctbal") > 0).alias("name"))


@query("jn36_reconciled_flows", """WITH f AS (SELECT n_nationkey AS k, n_nationkey % 3 + 1 AS n_arms, n_regionkey * 10 AS total FROM nation)
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey WHEN n_arms = 2 THEN total END AS randomized, CASE WHEN s_suppkey % 2 = 1 AND n_arms = 2 THEN 'randomized' ELSE '' END AS filled FROM supplier LEFT JOIN f ON k = s_nationkey""")
def reconciled_flows(t):
    rows = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("randomized"))
    flows = t.nation.select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 3 + 1).alias("n_arms"), (F.col("n_regionkey") * 10).cast("long").alias("total"))
    return binding.reconcile(rows, flows, "k", {"randomized": "total"}).select("s_suppkey", "randomized", F.array_join("filled", ",").alias("filled"))


@query("ag18_entity_merges", """SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS l_returnflag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS l_linestatus,
CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'l_returnflag ' ELSE '' END || CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'l_linestatus ' ELSE '' END AS conflicts, count(*) AS observations FROM lineitem GROUP BY l_orderkey""")
def entity_merges(t):
    merged = binding.merge_entities(t.lineitem, ["l_orderkey"], ["l_returnflag", "l_linestatus"])
    return merged.withColumn("conflicts", F.array_join(F.transform("conflicts", lambda x: F.concat(x, F.lit(" "))), ""))


@query("pl14_missing_fields", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 'UNCHANGED' WHEN l_linenumber = 1 THEN 'NOT_APPLICABLE_BY_RESULT_TYPE' WHEN l_linenumber = 2 THEN 'APPLICABILITY_UNRESOLVED' WHEN o_orderstatus = 'P' THEN 'CONFLICT_KEEP_UNRESOLVED'
WHEN l_returnflag = 'R' OR o_orderstatus = 'F' THEN 'POSITIVE_SOURCE_REQUIRES_EXTRACTION' WHEN o_orderkey % 2 = 0 THEN 'INSUFFICIENT_COVERAGE_KEEP_UNRESOLVED' ELSE 'NOT_REPORTED_WITH_SUFFICIENT_COVERAGE' END AS reason,
CASE WHEN l_linestatus = 'F' THEN 'PRESENT' WHEN l_linenumber = 1 THEN 'NOT_APPLICABLE' WHEN l_linenumber = 2 OR o_orderstatus IN ('P', 'F') OR l_returnflag = 'R' OR o_orderkey % 2 = 0 THEN 'UNRESOLVED' ELSE 'NOT_REPORTED' END AS after_status FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def missing_fields(t):
    none, n = F.array().cast("array<string>"), F.col("l_linenumber")
    fields = t.lineitem.select(
        F.col("l_orderkey").alias("entity"), n.alias("field"), F.when(F.col("l_linestatus") == "F", "PRESENT").otherwise("UNRESOLVED").alias("status"), F.lit(None).cast("string").alias("value"),
        F.when(F.col("l_returnflag") == "R", "in the text").otherwise("NR").alias("raw"), none.alias("evidence"), none.alias("candidates"),
        F.when(n == 1, "NOT_APPLICABLE").when(n == 2, "UNKNOWN").otherwise("APPLICABLE").alias("applicability"),
    )
    state = F.col("o_orderstatus")
    coverage = t.orders.select(F.col("o_orderkey").alias("entity"), (state == "F").alias("positive"), (state == "P").alias("conflicting"), (F.col("o_orderkey") % 2 == 1).alias("sufficient"))
    return binding.resolve_missing(fields, coverage).select(F.col("entity").alias("l_orderkey"), F.col("field").alias("l_linenumber"), "reason", "after_status")


BLOCKS = """b AS (SELECT l_orderkey AS page, l_linenumber AS n, CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 1 THEN 20 WHEN l_orderkey % 3 < 2 AND l_linenumber % 2 = 1 THEN 320 ELSE 20 END AS x0,
  CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 1 THEN 580 WHEN l_orderkey % 3 < 2 AND l_linenumber % 2 = 1 THEN 580 ELSE 280 END AS x1, l_quantity * 10 + l_linenumber / 8.0 AS y0 FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL))"""


def page_blocks(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").alias("q"))
    wide, right = (F.col("page") % 3 == 0) & (F.col("n") == 1), (F.col("page") % 3 < 2) & (F.col("n") % 2 == 1)
    return lines.select("page", "n", F.when(~wide & right, 320.0).otherwise(20.0).alias("x0"), F.when(wide | right, 580.0).otherwise(280.0).alias("x1"), (F.col("q") * 10 + F.col("n") / 8).alias("y0"), F.lit(600.0).alias("width"))


@query("sc08_column_counts", f"""WITH {BLOCKS}, c AS (SELECT page, n, (x0 + x1) / 2 AS centre FROM b), g AS (SELECT *, lead(centre) OVER w - centre AS gap, row_number() OVER w AS spot FROM c WINDOW w AS (PARTITION BY page ORDER BY centre)),
w AS (SELECT page, count(*) AS k, max(coalesce(gap, -1)) AS gap, max(spot) FILTER (coalesce(gap, -1) > 108) AS spot, count(*) FILTER (centre < 276) AS l, count(*) FILTER (centre > 324) AS r FROM g GROUP BY page)
SELECT page, CASE WHEN k < 6 THEN 1 WHEN (l >= 3 AND r >= 3) OR (gap > 108 AND spot >= 3 AND k - spot >= 2) THEN 2 ELSE 1 END AS columns FROM w""")
def column_counts(t):
    """Pages of one column, of two, and of a wide head over two: at most two gaps a page are wide."""
    return layout.column_counts(page_blocks(t), ["page"])


@query("sc09_reading_order", f"""WITH {BLOCKS}, c AS (SELECT *, (x0 + x1) / 2 AS centre, count(*) OVER (PARTITION BY page) >= 4 AND count(*) FILTER ((x0 + x1) / 2 < 312) OVER (PARTITION BY page) >= 3 AND count(*) FILTER ((x0 + x1) / 2 >= 288) OVER (PARTITION BY page) >= 3 AS two FROM b),
o AS (SELECT *, CASE WHEN NOT two THEN 0 WHEN x1 - x0 > 432 THEN CASE WHEN y0 < 170 THEN 0 ELSE 3 END WHEN centre < 300 THEN 1 ELSE 2 END AS band FROM c)
SELECT page, n, row_number() OVER (PARTITION BY page ORDER BY band, CASE WHEN two THEN y0 ELSE round(y0, 1) END, x0) AS place FROM o""")
def reading_order(t):
    return layout.reading_order(page_blocks(t), ["page"]).select("page", "n", "place")


@query("sc11_sc12_layout_chunks", """WITH c AS (SELECT p_partkey, p_partkey % 6 AS k, p_name FROM part)
SELECT p_partkey AS chunk_id, CASE k WHEN 1 THEN 'figure' WHEN 2 THEN 'heading' WHEN 3 THEN 'heading' WHEN 4 THEN 'formula' WHEN 5 THEN 'table' ELSE 'text' END AS kind, CASE k WHEN 2 THEN 'Results ' WHEN 3 THEN 'MATERIALS ' WHEN 4 THEN '± ' ELSE '' END || p_name AS content FROM c""")
def layout_chunks(t):
    at = F.col("p_partkey") % 6
    content = F.concat(F.when(at == 2, "Results ").when(at == 3, "MATERIALS ").when(at == 4, "± ").otherwise(""), "p_name")
    chunks = t.part.select(F.lit(1).alias("doc"), F.col("p_partkey").alias("chunk_id"), content.alias("content"), F.when(at == 1, "vision").when(at == 5, "table").otherwise("text").alias("source_type"), F.lit(None).cast("array<double>").alias("bbox"))
    blocks = layout.layout_blocks(chunks)
    return layout.retrieval_chunks(blocks, chunks.filter("source_type = 'table'")).drop("doc")


@query("tk15_cited_answers", """WITH h AS (SELECT o_custkey AS query, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, 'o' || o_orderkey AS id, o_orderkey, o_orderpriority FROM orders),
c AS (SELECT query, list_sort(list(DISTINCT 'x' || o_orderkey) FILTER (o_orderkey % 2 = 0)) AS unsupported, list_sort(list('k' || o_orderkey) FILTER (o_orderkey % 5 = 0)) AS against FROM h GROUP BY query)
SELECT query, string_agg(o_orderpriority || ' [cite: ' || id || ']', chr(10) ORDER BY rank) AS answer, array_to_string(list_sort(list(id)), ',') AS citation_ids, coalesce(array_to_string(any_value(unsupported), ','), '') AS unsupported, coalesce(array_to_string(any_value(against), ','), '') AS contradiction_ids FROM h JOIN c USING (query) GROUP BY query""")
def cited_answers(t):
    """Orders as hits of their customer's question; even ones are also cited under a wrong name, every fifth contradicts."""
    key, name = F.col("o_custkey").alias("query"), lambda x: F.concat(F.lit(x), "o_orderkey")
    even = F.col("o_orderkey") % 2 == 0
    hits = t.orders.select(key, F.col("o_orderkey").alias("rank"), name("o").alias("citation_id"), F.when(even, F.col("o_orderpriority")).alias("summary"), F.col("o_orderpriority").alias("text"))
    cited = t.orders.select(key, F.when(even, name("x")).otherwise(name("o")).alias("citation_id"))
    against = t.orders.select(key, name("k").alias("contradiction_id"), F.when(F.col("o_orderkey") % 5 == 0, "conflict").otherwise("agreement").alias("status"))
    out = answers.cited_answer(hits, cited, against)
    return out.select("query", "answer", *[F.array_join(c, ",").alias(c) for c in ("citation_ids", "unsupported", "contradiction_ids")])


@query("st51_st52_enriched_chunks", """SELECT p_partkey, CASE WHEN s_suppkey IS NOT NULL THEN s_name || CASE WHEN p_partkey % 2 = 0 THEN ' | ' || p_name ELSE '' END ELSE CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END END AS prefix, coalesce('10.' || s_suppkey, p_size::VARCHAR) || '/' || p_partkey AS citation_id FROM part LEFT JOIN supplier ON s_suppkey = p_size""")
def enriched_chunks(t):
    chunks = t.part.select(F.col("p_partkey").alias("chunk_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_name"), F.lit(" "))).otherwise(" ").alias("prefix"), F.col("p_size").cast("long").alias("study"))
    known = t.supplier.select(F.col("s_suppkey").alias("study"), F.concat(F.lit("10."), "s_suppkey").alias("doi"), F.col("s_name").alias("header"))
    return answers.enriched(chunks, known, "study").select(F.col("chunk_id").alias("p_partkey"), "prefix", "citation_id")


@query("st47_first_evidence", """SELECT conv_id, coalesce(min(turn) FILTER (contains(text, substr(w, 1, 12))), min(turn)) AS chunk_id FROM (SELECT *, last_value(text) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS w FROM conversations) GROUP BY conv_id""")
def first_evidence(t):
    """The first turn with the first characters of a conversation's last turn."""
    found = t.conversations.groupBy("conv_id").agg(F.max(F.struct("turn", "text"))["text"].alias("value"))
    return answers.first_evidence(t.conversations.select("conv_id", F.col("turn").alias("chunk_id"), F.col("text").alias("content")), found, "conv_id").select("conv_id", "chunk_id")


@query("ag23_finding_scores", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 56 WHEN 1 THEN 65 WHEN 2 THEN NULL ELSE 20 END AS score FROM customer""")
def finding_scores(t):
    found = pick("c_custkey", "Correct|missing|partially_incorrect|gold_ambiguous|unheard|missing|correct|partially_incorrect|missing", "acceptable|missing|gold_ambiguous|gold_ambiguous", "nothing|", "incorrect|partially_incorrect")
    return t.customer.select("c_custkey", metrics.finding_score(F.split(found, r"\|")).alias("score"))


@query("ag22_module_means", """SELECT p_partkey, round_even((p_size + p_retailprice + p_partkey) / 3, 2) AS mean FROM part""")
def module_means(t):
    rows = t.part.select("p_partkey", F.col("p_size").alias("a"), F.lit(-1.0).alias("b"), F.col("p_partkey").alias("c"), F.col("p_retailprice").alias("again"))
    return metrics.module_mean(rows, "p_partkey", ["a", "b", "c"], "b", "again")


@query("ag24_row_audits", """SELECT l_orderkey, count(*) AS n_rows, count(*) FILTER (l_quantity > 40 OR l_returnflag = 'N') AS n_missing, round(avg(CASE WHEN l_quantity <= 40 AND l_returnflag <> 'N' THEN l_quantity * 2.5 END), 9) AS mean
FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def row_audits(t):
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    scored = lines.filter("f <> 'N'").select("l_orderkey", "l_linenumber", (F.col("q") * 2.5).alias("score"))
    return metrics.row_audit(lines.select("l_orderkey", "l_linenumber"), scored, "l_orderkey", "l_linenumber", "score").withColumn("mean", F.round("mean", 9))


@query("ag09_registry_audit", """WITH r AS (SELECT p_name AS field_id, count(*) AS n, bool_or(p_size > 25) AS enabled FROM part WHERE p_size % 2 = 0 GROUP BY p_name), s AS (SELECT DISTINCT p_name AS field_id FROM part WHERE p_size % 3 = 0)
SELECT coalesce(r.field_id, s.field_id) AS field_id, CASE WHEN n IS NULL THEN 'UNREGISTERED' WHEN n > 1 THEN 'DUPLICATE' WHEN s.field_id IS NULL AND enabled THEN 'INVALID' WHEN s.field_id IS NOT NULL AND length(s.field_id) % 2 = 0 THEN 'TYPE_MISMATCH' ELSE 'OK' END AS finding FROM r FULL JOIN s USING (field_id)""")
def registry_audit(t):
    """Part names of even sizes as the registry, those of sizes divisible by three as the schema, where longer names have other types."""
    registry = t.part.filter("p_size % 2 = 0").select(F.col("p_name").alias("field_id"), F.lit("text").alias("value_type"), (F.col("p_size") > 25).alias("enabled"))
    schema = t.part.filter("p_size % 3 = 0").select(F.col("p_name").alias("field_id"), F.when(F.length("p_name") % 2 == 0, "number").otherwise("text").alias("value_type")).distinct()
    return metrics.registry_audit(registry, schema)
