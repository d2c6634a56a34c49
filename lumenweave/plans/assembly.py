"""Queries over table topology, bookkeeping and the assembly of graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import answers, assembly, planning, topology

from .binding import ARMS, arm_index
from .labels import pick
from .registry import query


@query("st24_cell_specs", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ':2:1;' || p_brand || ':1:' || p_size ELSE p_name || '|x:1:1;' || p_size || ':1:1' END AS cells FROM part""")
def cell_specs(t):
    html = F.concat(F.lit('<tr><th rowspan="2">'), "p_name", F.lit("</th><td class=a colspan="), "p_size", F.lit("> "), "p_brand", F.lit("</td></tr>"))
    piped = F.concat(F.lit("| "), "p_name", F.lit("\\|x | "), "p_size", F.lit(" |"))
    cells = topology.cell_specs(F.when(F.col("p_partkey") % 2 == 0, html).otherwise(piped))
    return t.part.select("p_partkey", F.array_join(F.transform(cells, lambda x: F.concat_ws(":", x["cell"], x["rowspan"], x["colspan"])), ";").alias("cells"))


def header_cells(t):
    """Three header rows over one column a part: a group, the group again, and a week."""
    group = F.concat(F.col("p_brand"), F.lit(" group (n = "), F.col("p_size"), F.lit(")"))
    rows = F.array(*[F.struct(F.lit(i).alias("row"), c.alias("cell")) for i, c in enumerate((group, group, F.concat(F.lit("Week score, "), "p_size", F.lit(" weeks"))))])
    return t.part.select(F.lit("t").alias("table"), F.col("p_partkey").alias("col"), F.explode(rows).alias("x")).select("table", "col", "x.*")


@query("st30_column_maps", """SELECT p_partkey AS col, g || ' > Week score, ' || p_size || ' weeks' AS path, g AS arm, p_size || ' weeks' AS time FROM (SELECT *, p_brand || ' group (n = ' || p_size || ')' AS g FROM part)""")
def column_maps(t):
    return topology.column_map(header_cells(t)).select("col", F.array_join("path", " > ").alias("path"), "arm", "time")


@query("st31_arm_registries", """SELECT DISTINCT p_brand || ' group' AS arm, p_size AS n FROM part""")
def arm_registries(t):
    return topology.arm_registry(header_cells(t)).select("arm", "n")


@query("st76_first_row_headers", """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'given' WHEN n_nationkey % 3 = 1 THEN 'sham group,control,x' ELSE '' END AS header, CASE WHEN n_nationkey % 3 = 1 THEN 1 ELSE 2 END AS n FROM nation""")
def first_row_headers(t):
    rows = F.array(F.array(F.lit("sham group"), F.when(F.col("n_nationkey") % 3 == 2, "y").otherwise("control"), F.lit("x")), F.array(F.lit("1"), F.lit("2"), F.lit("3")))
    made = t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("given"))).alias("header"), rows.alias("rows"))
    return topology.headed_by_first_row(made).select("n_nationkey", F.coalesce(F.array_join("header", ","), F.lit("")).alias("header"), F.size("rows").alias("n"))


def rendered(t):
    """A context an order: a marked row for each of its lines."""
    one = F.concat(F.lit("[ROW "), "l_linenumber", F.lit("] item "), "l_linenumber", F.lit(" |  "), "q", F.lit(" ROW_ID=r"), "l_linenumber", F.lit("#part-2"))
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q")).select("l_orderkey", F.struct("l_linenumber", one.alias("s")).alias("x"))
    return lines.groupBy("l_orderkey").agg(F.concat(F.lit("head\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n")).alias("text"))


@query("st34_recovered_rows", """SELECT l_orderkey AS id, CASE WHEN l_orderkey % 3 = 1 THEN 'r9' WHEN l_orderkey % 3 = 2 THEN 'NR' ELSE 'r' || min(l_linenumber) || '#part-2' END AS row_id FROM lineitem GROUP BY l_orderkey""")
def recovered_rows(t):
    made = rendered(t)
    quote = F.when(F.col("l_orderkey") % 3 == 0, "ITEM  ").when(F.col("l_orderkey") % 3 == 1, "unseen, ROW_ID: r9; x").otherwise("never seen")
    quotes = made.select(F.col("l_orderkey").alias("id"), "l_orderkey", quote.alias("quote"))
    return topology.recover_row_ids(quotes, topology.marked_rows(made, "l_orderkey", "text"), "l_orderkey").select("id", "row_id")


@query("st36_row_quotes", """SELECT o_orderkey, coalesce(q, '') AS quote FROM orders LEFT JOIN (SELECT l_orderkey, 'item 1 | ' || max(l_quantity)::INT AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def row_quotes(t):
    wanted = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit("r1").alias("row_id"))
    found = topology.row_quotes(wanted, topology.marked_rows(rendered(t), "l_orderkey", "text"), "l_orderkey")
    return found.select(F.col("l_orderkey").alias("o_orderkey"), "quote")


@query("st37_evidence_units", """SELECT c.conv_id AS id, md5(arg_min(u.text, u.turn)) AS digest FROM (SELECT conv_id, lower(trim(regexp_replace(substr(arg_max(text, turn), 1, 25), '\\s+', ' ', 'g'))) AS q FROM conversations GROUP BY conv_id) c
JOIN conversations u ON u.conv_id = c.conv_id AND contains(lower(trim(regexp_replace(u.text, '\\s+', ' ', 'g'))), q) GROUP BY c.conv_id""")
def evidence_units(t):
    quotes = t.conversations.groupBy("conv_id").agg(F.substring(F.max_by("text", "turn"), 1, 25).alias("quote")).withColumn("id", F.col("conv_id"))
    units = t.conversations.select("conv_id", F.col("turn").alias("place"), F.col("text").alias("unit"))
    return topology.evidence_units(quotes, units, "conv_id").select("id", F.md5("unit").alias("digest"))


@query("st77_footnotes", """SELECT p_partkey, k AS run, CASE k WHEN 1 THEN 'note ' || p_name ELSE 'last' END AS footnote FROM part, (SELECT unnest([1, 2]) AS k)""")
def footnotes(t):
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), c.alias("content")) for kind, c in (("text", F.lit("before")), ("table", F.lit("|a|")), ("table", F.lit("|b|")), ("text", F.lit(" ")), ("text", F.concat(F.lit("note "), "p_name")), ("text", F.lit("more")), ("table", F.lit("|c|")), ("text", F.lit("last ")))])
    return topology.footnotes(t.part.select("p_partkey", F.posexplode(rows).alias("line", "x")).select("p_partkey", "line", "x.*"), "p_partkey")


@query("ag37_request_tally", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def request_tally(t):
    return planning.request_tally(t.events, "event_type")


@query("so12_acknowledged_rows", """SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT 'r' || l_linenumber)), ',') AS row_ids FROM lineitem GROUP BY l_orderkey""")
def acknowledged_rows(t):
    part = F.concat(F.lit("r"), "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, "#part-1").otherwise(""))
    told = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "R", part)).alias("rows"), F.collect_list(F.when(F.col("l_returnflag") != "R", part)).alias("skipped"))
    return planning.acknowledged(told, "l_orderkey", ["rows", "skipped"]).select("l_orderkey", F.array_join("row_ids", ",").alias("row_ids"))


@query("so18_allowed_requests", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def allowed_requests(t):
    plan = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return planning.allowed(t.orders.select("o_orderkey", "o_custkey"), plan, "o_custkey")


@query("so21_retries", """SELECT l_orderkey, count(*) FILTER (NOT seen) > 0 AS retry, count(*) FILTER (NOT seen) AS "left" FROM (SELECT *, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey, l_linenumber) AS seen FROM lineitem) GROUP BY l_orderkey""")
def retries(t):
    return planning.needs_retry(t.lineitem.select("l_orderkey", "l_linenumber"), t.lineitem.filter("l_returnflag = 'R'"), "l_orderkey", "l_linenumber")


@query("wn17_first_parent_changes", """SELECT p_partkey, ['UNKNOWN', 'SKILL_EXTRACTION', 'RESULT_CONSTRUCTION', 'PARENT_BINDING', 'MERGER', 'FINAL_PROJECTION', 'UNKNOWN'][(p_partkey % 7 + 1)::INT] AS stage, CASE p_partkey % 7 WHEN 0 THEN 'ARTIFACT_NOT_AVAILABLE' WHEN 1 THEN 'PARENT_INCOMPLETE_AT_EXTRACTION' WHEN 2 THEN 'PARENT_CHANGED_DURING_RESULT_CONSTRUCTION'
WHEN 3 THEN 'PARENT_LOST_DURING_RESULT_CONSTRUCTION' WHEN 4 THEN 'PARENT_CHANGED_DURING_MERGE' WHEN 5 THEN 'WRONG_OUTCOME' ELSE 'OTHER' END AS reason FROM part""")
def first_parent_changes(t):
    at = F.col("p_partkey") % 7
    since = lambda k: F.when((at >= 2) & (at <= k), F.lit(None).cast("string") if k == 3 else F.lit("other")).otherwise(F.col("p_brand"))
    rows = t.part.select("p_partkey", F.col("p_brand").alias("candidate_parent"), since(2).alias("construction_parent"), since(3).alias("binding_parent"), since(4).alias("merger_parent"), since(5).alias("final_parent"))
    got = planning.first_parent_change(at != 0, at != 1)
    return rows.select("p_partkey", got.alias("x")).select("p_partkey", "x.*")


@query("pf22_priorities", """SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'P0' WHEN p_brand = 'Brand#2' THEN 'P1' ELSE 'P2' END AS priority FROM part""")
def priorities(t):
    known = t.part.filter("p_brand IN ('Brand#1', 'Brand#2')").select("p_brand", F.when(F.col("p_brand") == "Brand#1", "P0").otherwise("P1").alias("priority")).distinct()
    return planning.with_priority(t.part.select("p_partkey", "p_brand"), known, ["p_brand"]).select("p_partkey", "priority")


@query("pf27_relevant_bindings", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def relevant_bindings(t):
    used = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("s_nationkey"))
    return planning.relevant_bindings(t.supplier.select("s_suppkey", "s_nationkey"), used, "s_nationkey")


@query("jn11_prior_statuses", """SELECT c_custkey, coalesce(max(o_orderstatus), 'UNSEEN') AS prior_status, coalesce(array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderpriority IS NOT NULL)), ','), '') AS candidates FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def prior_statuses(t):
    prior = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("status"), F.array_sort(F.collect_set("o_orderpriority")).alias("candidates"))
    return planning.prior_statuses(t.customer.select("c_custkey"), prior, ["c_custkey"]).select("c_custkey", "prior_status", F.array_join("candidates", ",").alias("candidates"))


@query("st62_related_records", """SELECT l_orderkey, coalesce(arg_min(l_linenumber, l_linenumber) FILTER (l_returnflag = 'A'), min(l_linenumber)) AS intervention, coalesce(min(l_linenumber) FILTER (l_returnflag = 'R'), list_sort(list(l_linenumber))[2]) AS control FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def related_records(t):
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    arms = lines.select("l_orderkey", F.col("l_linenumber").alias("place"), F.col("l_linenumber").alias("name"), F.when(F.col("f") == "A", "intervention").when(F.col("f") == "R", "control").alias("role"))
    return assembly.related_records(arms, "l_orderkey")


@query("st63_two_arms", """SELECT s_suppkey, role, CASE role WHEN 'control' THEN s_nationkey ELSE s_suppkey END AS n FROM supplier, (SELECT unnest(['intervention', 'control']) AS role)""")
def two_arms(t):
    return assembly.two_arms(t.supplier, "s_suppkey", {"n": (F.col("s_suppkey"), F.col("s_nationkey").cast("long"))})


@query("pf30_evidence_lists", """SELECT p_partkey, field, place, id AS evidence_id FROM (SELECT p_partkey, 'a' AS field, 0 AS place, p_name AS id FROM part UNION ALL SELECT p_partkey, 'b', 1, unnest([p_brand, p_type]) FROM part)""")
def evidence_lists(t):
    made = t.part.select("p_partkey", F.array("p_name").alias("a"), F.array("p_brand", "p_type").alias("b"), F.array().cast("array<string>").alias("c"))
    return assembly.evidence_of(made, "p_partkey", ["a", "b", "c"])


@query("so02_comparable_sets", """SELECT DISTINCT 'part' AS kind, lower(p_brand) || '|' || lower(p_type) AS item FROM part UNION ALL SELECT DISTINCT 'supplier', lower(s_name) FROM supplier UNION ALL SELECT DISTINCT 'customer', 'nr|' || lower(c_mktsegment) FROM customer""")
def comparable_sets(t):
    customers = t.customer.select(F.lit(None).cast("string").alias("none"), F.concat(F.lit(" "), "c_mktsegment").alias("c_mktsegment"))
    return assembly.comparable_sets({"part": (t.part, ["p_brand", "p_type"]), "supplier": (t.supplier, ["s_name"]), "customer": (customers, ["none", "c_mktsegment"])})


@query("sc27_merged_metadata", """SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey % 2 = 0 THEN 'first ' || n_nationkey ELSE 'second ' || n_nationkey END AS title, CASE WHEN n_nationkey % 3 = 0 THEN 'a: timeout' ELSE '' END AS errors FROM nation""")
def merged_metadata(t):
    at = F.col("n_nationkey")
    a = t.nation.select("n_nationkey", F.when(at % 2 == 0, F.concat(F.lit("first "), at)).alias("title"), F.when(at % 3 == 0, "timeout").alias("error"))
    b = t.nation.select("n_nationkey", F.concat(F.lit("second "), at).alias("title"), F.lit(None).cast("string").alias("error"))
    return assembly.merged_metadata(t.nation.select("n_nationkey"), {"a": a, "b": b}, "n_nationkey", ["title"]).withColumn("errors", F.array_join("errors", "; "))


@query("pl20_jn28_assembled_graph", f"""WITH {ARMS}, r AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_tax, 'part ' || l_partkey AS alias FROM lineitem)
SELECT id AS arm_id, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'flag' ELSE '' END AS conflicts, count(*) AS observations FROM r JOIN only_one USING (alias) GROUP BY id""")
def assembled_graph(t):
    """Line items as source rows that name parts as their arms."""
    records = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("Part  "), "l_partkey").alias("label"), F.col("l_returnflag").alias("flag"))
    results, _ = assembly.assemble(records, arm_index(t), [], ["flag"])
    return results.withColumn("conflicts", F.array_join("conflicts", ","))


@query("aj14_graph_exports", """SELECT n_regionkey, '{"nations":[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || '],"none":[]}' AS graph FROM nation GROUP BY n_regionkey""")
def graph_exports(t):
    nations = t.nation.select("n_regionkey", "n_nationkey", "n_name")
    return assembly.graph_json({"nations": nations, "none": nations.limit(0)}, "n_regionkey")


@query("st49_source_urls", """SELECT s_suppkey, 'a https://x/' || s_suppkey || CASE WHEN s_nationkey % 2 = 0 THEN '; b https://y/' || s_nationkey ELSE '' END AS urls FROM supplier""")
def source_urls(t):
    one = lambda source, url: F.struct(F.lit(source).alias("source"), url.alias("url"))
    x, y = F.concat(F.lit("https://x/"), "s_suppkey"), F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("https://y/"), "s_nationkey"))
    urls = answers.first_urls(F.array(one("a", x), one("b", x), one("b", y), one("c", x)))
    return t.supplier.select("s_suppkey", F.array_join(F.transform(urls, lambda u: F.concat_ws(" ", u["source"], u["url"])), "; ").alias("urls"))


@query("st52_prefixed_contexts", """SELECT n_nationkey, 'H' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || chr(10) || n_name ELSE '' END AS a FROM nation""")
def prefixed_contexts(t):
    contexts = F.create_map(F.lit("a"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(" "))
    return t.nation.select("n_nationkey", answers.prefixed(contexts, F.concat(F.lit("H"), "n_nationkey"))["a"].alias("a"))


@query("jn28_unresolved_warnings", f"""WITH {ARMS} SELECT s_suppkey AS id, 'UNKNOWN_ARM' AS warning FROM supplier WHERE s_suppkey % 2 = 1 AND 'item ' || s_suppkey NOT IN (SELECT alias FROM index)""")
def unresolved_warnings(t):
    label = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("part "), "s_suppkey")).otherwise(F.concat(F.lit("item "), "s_suppkey"))
    return assembly.assemble(t.supplier.select(F.col("s_suppkey").alias("id"), label.alias("label"), "s_nationkey"), arm_index(t), [], ["s_nationkey"])[1]


@query("tk12_search", None)
def search(t):
    """The ten documents that a lexical search ranks first, with their citations."""
    return answers.search(t.documents, ["the", "and", "ring"], 10)


@query("pf17_field_structs", """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'PRESENT' ELSE 'NOT_REPORTED' END AS status, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS value, c_mktsegment AS raw, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n_evidence FROM customer""")
def field_structs(t):
    made = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, "PRESENT").otherwise("NOT_REPORTED").alias("s"), F.col("c_mktsegment").alias("v"), F.when(F.col("c_custkey") % 2 == 0, F.array("c_name")).alias("e"))
    field = assembly.field_struct("s", "v", "v", "e")
    return made.select("c_custkey", field.alias("f")).select("c_custkey", "f.status", "f.value", "f.raw", F.size("f.evidence").alias("n_evidence"))


@query("pf03_module_contexts", """WITH l AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn, role) AS k FROM conversations WHERE role = 'user' OR regexp_matches(lower(text), 'rights')) SELECT c.conv_id, md5(coalesce(x, '')) AS digest FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS x FROM l WHERE k = 1 GROUP BY conv_id) USING (conv_id)""")
def module_contexts(t):
    """What users say in a conversation, and whatever speaks of rights."""
    lines = t.conversations.select("conv_id", F.col("turn").alias("line"), F.col("role").alias("section"), F.col("text").alias("content"))
    return assembly.module_contexts(lines, "conv_id", {"said": (["user"], "(?i)rights")}).select("conv_id", F.md5("said").alias("digest"))
