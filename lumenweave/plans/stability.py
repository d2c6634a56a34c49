"""Queries over repeated runs, findings by path, and texts routed into sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import text
from lumenweave.operators import documents, stability

from .registry import query

RUN = "CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END"


@query("so05_value_stability", f"""WITH l AS (SELECT user_id || '/' || event_type AS slot, {RUN} AS run, max_by({{'v': CASE WHEN value > 2 THEN floor(value / 40)::BIGINT END, 's': CASE WHEN value > 30 THEN 'high' ELSE 'low' END, 'r': event_type || CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '-' END || floor(value / 60)::BIGINT}}, event_id) AS x FROM events GROUP BY ALL)
SELECT slot, CASE WHEN count(*) < 3 OR count(x.v) BETWEEN 1 AND 2 THEN 'MISSING_IN_ONE_RUN' WHEN count(DISTINCT coalesce(x.v::VARCHAR, '')) > 1 THEN 'DIFFERENT_VALUE' WHEN count(DISTINCT x.s) > 1 OR count(DISTINCT replace(x.r, '-', ' ')) > 1 THEN 'REPRESENTATION_ONLY_DIFFERENCE' ELSE 'SAME_VALUE' END AS category FROM l GROUP BY slot""")
def value_stability(t):
    """Users' kinds of events as slots with a value, a statistic and a raw text, in three runs."""
    run = F.when(F.col("event_id") % 3 == 0, "a").when(F.col("event_id") % 3 == 1, "b").otherwise("c")
    band = lambda n: F.floor(F.col("value") / n).cast("string")
    rows = t.events.select(
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("slot"), run.alias("run"), F.col("event_id").alias("ord"), F.when(F.col("value") > 2, band(40)).alias("value"),
        F.when(F.col("value") > 30, "high").otherwise("low").alias("statistic"), F.concat("event_type", F.when(F.col("event_id") % 2 == 0, " ").otherwise("-"), band(60)).alias("raw"),
    )
    return stability.value_stability(rows, ["a", "b", "c"])


@query("so08_contract_class", """WITH r AS (SELECT c_nationkey, c_mktsegment AS key, CASE WHEN c_acctbal < -985 THEN 'DIFFERENT' WHEN c_acctbal > 9950 THEN NULL WHEN c_acctbal > 9900 THEN 'NOT_AVAILABLE' ELSE 'SAME' END AS status FROM customer WHERE c_custkey % 7 > 0),
k AS (SELECT * FROM r WHERE key IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')), g AS (SELECT c_nationkey, coalesce(bool_or(status = 'DIFFERENT'), false) AS d, bool_or(status IS NULL OR status = 'NOT_AVAILABLE') AS u, count(DISTINCT key) FILTER (status IS NOT NULL AND status <> 'NOT_AVAILABLE') AS n FROM k GROUP BY c_nationkey)
SELECT a.c_nationkey, CASE WHEN d THEN 'RUN_CONTRACT_DRIFT' WHEN coalesce(u, true) OR n < 3 THEN 'CONTRACT_NOT_PROVABLE' ELSE 'STOCHASTIC_LLM_DRIFT' END AS drift FROM (SELECT DISTINCT c_nationkey FROM r) a LEFT JOIN g USING (c_nationkey)""")
def contract_class(t):
    """Nations as pairs of runs, segments as keys of their contract."""
    balance = F.col("c_acctbal")
    status = F.when(balance < -985, "DIFFERENT").when(balance > 9950, None).when(balance > 9900, "NOT_AVAILABLE").otherwise("SAME")
    rows = t.customer.filter("c_custkey % 7 > 0").select("c_nationkey", F.col("c_mktsegment").alias("key"), status.alias("status"))
    return stability.contract_class(rows, "c_nationkey", ["BUILDING", "AUTOMOBILE", "MACHINERY"])


LAYERS = list(stability.LAYER_DRIFT)


@query("wn18_first_differing_layer", f"""WITH e AS (SELECT o_custkey AS g, ['a', 'b', 'c'][(o_orderkey % 3 + 1)::INT] AS run, {LAYERS}[((o_orderkey // 3) % 6 + 1)::INT] AS layer, (count(*) % 2)::VARCHAR AS digest FROM orders GROUP BY ALL),
r AS (SELECT DISTINCT g, run FROM e WHERE run <> 'a'), b AS (SELECT * FROM e WHERE run = 'a'), w AS (SELECT r.g, r.run, l.layer, x.digest AS d, b.digest AS base FROM r, (SELECT unnest({LAYERS}) AS layer) l LEFT JOIN e x ON x.g = r.g AND x.run = r.run AND x.layer = l.layer LEFT JOIN b ON b.g = r.g AND b.layer = l.layer),
f AS (SELECT g, run, arg_min(layer, list_position({LAYERS}, layer)) FILTER (d IS DISTINCT FROM base) AS layer FROM w GROUP BY g, run)
SELECT f.g, f.run, coalesce(f.layer, 'NONE') AS first_difference, i.interpretation FROM f JOIN (SELECT g, CASE min(list_position({LAYERS}, layer)) WHEN 1 THEN 'parser drift' WHEN 2 THEN 'retrieval/context drift' WHEN 3 THEN 'LLM Skill raw-output variance' WHEN 4 THEN 'construction/merger or downstream variance' WHEN 5 THEN 'construction/merger or downstream variance' WHEN 6 THEN 'construction/merger or downstream variance' ELSE 'no observed drift in compared layers' END AS interpretation FROM f GROUP BY g) i USING (g)""")
def first_differing_layer(t):
    """Customers' orders as layers of three runs, told apart by whether their number is even."""
    pick = lambda values, c: F.get(F.array(*map(F.lit, values)), c.cast("int"))
    key = F.col("o_orderkey")
    rows = t.orders.groupBy(F.col("o_custkey").alias("g"), pick("abc", key % 3).alias("run"), pick(LAYERS, F.floor(key / 3) % 6).alias("layer")).agg((F.count("*") % 2).cast("string").alias("digest"))
    found = stability.first_differences(rows, "g", "a")
    return found.join(stability.drift_of(found, "g"), "g")


@query("jn44_findings_by_path", """WITH p AS (SELECT DISTINCT 'lines[' || l_linenumber || '].' || lower(l_returnflag) || '.f' || l_suppkey % 9 || CASE WHEN l_partkey % 2 = 0 THEN '[' || l_partkey % 4 || ']' ELSE '' END AS path FROM lineitem),
f AS (SELECT s_suppkey AS ord, trim(CASE s_suppkey % 5 WHEN 0 THEN 'f' || s_suppkey % 13 WHEN 1 THEN 'a.f' || s_suppkey % 9 WHEN 2 THEN ' n.f' || s_suppkey % 9 || '[1] ' WHEN 3 THEN 'lines[2].r.f' || s_suppkey % 9 ELSE '' END) AS field, 's' || s_suppkey AS finding FROM supplier)
SELECT path, arg_min(finding, ord) AS finding FROM p LEFT JOIN f ON field <> '' AND (field = path OR field = string_split(string_split(path, '.')[-1], '[')[1] OR path LIKE '%.' || replace(field, '_', '\\_')) GROUP BY path""")
def findings_by_path(t):
    """Fields of nested lines and the first supplier that names their path, its end or its leaf."""
    text_of = lambda c: c.cast("string")
    index = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("["), text_of(F.col("l_partkey") % 4), F.lit("]"))).otherwise("")
    paths = t.lineitem.select(F.concat(F.lit("lines["), text_of(F.col("l_linenumber")), F.lit("]."), F.lower("l_returnflag"), F.lit(".f"), text_of(F.col("l_suppkey") % 9), index).alias("path"))
    key = F.col("s_suppkey")
    ninth = text_of(key % 9)
    field = (
        F.when(key % 5 == 0, F.concat(F.lit("f"), text_of(key % 13))).when(key % 5 == 1, F.concat(F.lit("a.f"), ninth)).when(key % 5 == 2, F.concat(F.lit(" n.f"), ninth, F.lit("[1] ")))
        .when(key % 5 == 3, F.concat(F.lit("lines[2].r.f"), ninth)).otherwise("")
    )
    return stability.suffix_matches(paths, t.supplier.select(field.alias("field"), key.alias("ord"), F.concat(F.lit("s"), text_of(key)).alias("finding")))


def _marked(t):
    """Documents with markers of pages and headings put before every line: a page each third line, a heading each fourth."""
    names = ("Abstract", "# Materials and methods", "RESULTS", "Words unknown", "Discussion", "References")
    line = lambda x, i: F.concat(
        F.when(i % 3 == 2, F.concat(F.lit("<!-- page "), (i / 3 + 2).cast("int").cast("string"), F.lit(" -->\n"))).otherwise(""),
        F.when(i % 4 == 1, F.concat(F.lit("# "), F.get(F.array(*map(F.lit, names)), (i % 6).cast("int")), F.lit("\n"))).otherwise(""), x,
    )
    return t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


SECTION = "CASE " + " ".join(f"WHEN regexp_matches(h, '{pattern}') THEN '{code}'" for pattern, code in documents.SECTIONS) + " END"


@query("pf02_routed_lines", rf"""WITH d AS (SELECT doc_id, string_split(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 2 THEN '<!-- page ' || ((i - 1) // 3 + 2) || ' -->' || chr(10) ELSE '' END
  || CASE WHEN (i - 1) % 4 = 1 THEN '# ' || ['Abstract', '# Materials and methods', 'RESULTS', 'Words unknown', 'Discussion', 'References'][(i - 1) % 6 + 1] || chr(10) ELSE '' END || x), chr(10)), chr(10)) AS xs FROM documents),
n AS (SELECT doc_id, unnest(xs) AS content, generate_subscripts(xs, 1) - 1 AS line FROM d), k AS (SELECT doc_id, line, content, try_cast(nullif(regexp_extract(content, '^<!--\s*page\s+([0-9]+)\s*-->$', 1), '') AS INT) AS pg, trim(regexp_replace(lower(nullif(regexp_extract(content, '^#+\s*(.+)$', 1), '')), '[^a-z]+', ' ', 'g')) AS h FROM n),
s AS (SELECT *, CASE WHEN h IS NOT NULL THEN {SECTION} END AS code FROM k)
SELECT doc_id, line::INT AS line, CASE WHEN pg IS NOT NULL THEN 'page' WHEN h IS NOT NULL THEN 'heading' WHEN regexp_matches(content, '^\s*\|.*\|\s*$') THEN 'table' WHEN trim(content, ' ') = '' THEN 'blank' ELSE 'text' END AS kind,
coalesce(last_value(pg IGNORE NULLS) OVER w, 1) AS page, coalesce(last_value(code IGNORE NULLS) OVER w, 'OTHER') AS section FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def routed_lines(t):
    """Every line of documents with pages and headings put in, by kind, page and section."""
    return documents.routed(_marked(t), "doc_id", "text").select("doc_id", "line", "kind", "page", "section")


@query("st46_st48_repaired_contacts", """SELECT o_orderkey, '10.1234/ab.' || o_orderkey || ',10.5555/x(' || o_custkey AS dois, 'user' || o_custkey || '@mail.example.org,a.b' || o_orderkey || '@x-y.net' AS emails FROM orders""")
def repaired_contacts(t):
    """DOIs and mail addresses of notes about orders: repeats in other case, marks at their ends, spaces around @ and dots."""
    order, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    note = F.concat(
        F.lit("See https://doi.org/10.1234/AB."), order, F.lit("; doi:10.5555/x("), customer, F.lit(") and 10.1234/ab."), order, F.lit(". Write to User"), customer, F.lit(" @ mail . example.org or A.B"), order, F.lit("@x-y.net, user"),
        customer, F.lit("@mail.example.org"),
    )
    return t.orders.select("o_orderkey", F.array_join(text.dois(note), ",").alias("dois"), F.array_join(text.emails(note), ",").alias("emails"))


@query("sc22_html_tables_once", """SELECT p_partkey, 'table-' || n AS table_id, CASE WHEN n = 1 THEN 'Name|Size' ELSE '' END AS header, CASE WHEN n = 1 THEN p_name || '|' || p_size ELSE p_brand || '|x' END AS rows FROM part, (SELECT unnest([1, 2]) AS n)""")
def html_tables_once(t):
    """Tables of pages made of parts: one with a header, the same again in other case, one without."""
    table = lambda tag, body: F.concat(F.lit(f"<p>text</p><{tag} class='x'>"), body, F.lit(f"</{tag}>"))
    headed = F.concat(F.lit("<tr><th>Name</th><th> Size</th></tr><tr><td>"), "p_name", F.lit("</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr>"))
    again = F.regexp_replace(F.regexp_replace(headed, "<td>", "<TD>"), "</td>", "</TD>")
    html = F.concat(table("table", headed), table("TABLE", F.upper(again)), table("table", F.concat(F.lit("<tr><td>"), "p_brand", F.lit("</td><td>x</td></tr>"))))
    part = t.part.repartition(int(t.part.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    found = documents.html_tables(part.select("p_partkey", html.alias("html")), "p_partkey", "html")
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/")
    return found.select("p_partkey", "table_id", F.coalesce(F.array_join("header", "|"), F.lit("")).alias("header"), rows.alias("rows"))
