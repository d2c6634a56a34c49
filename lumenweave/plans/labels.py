"""Queries over codes, keys and times in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenweave.functions import labels

from .registry import query


def pick(by: str, *texts: str | None) -> Column:
    """One of some texts, by a whole number."""
    return F.get(F.array(*[F.lit(x) for x in texts]), F.pmod(F.col(by), F.lit(len(texts))).cast("int"))


@query("pf05_title_sections", """SELECT n_nationkey, ['abstract', 'methods', 'methods', 'results', 'discussion', 'references', 'metadata', 'unknown'][(n_nationkey % 8 + 1)::INT] AS section FROM nation""")
def title_sections(t):
    title = pick("n_nationkey", "Structured ABSTRACT.", "Statistical analysis", "Participants", "Main Findings", "Discussion and conclusion", "References", "Competing interests", "Appendix")
    return t.nation.select("n_nationkey", labels.title_section(title).alias("section"))


@query("st56_comparison_codes", """SELECT p_partkey, ['B', 'C', 'A', 'D', 'E'][(p_partkey % 5 + 1)::INT] AS code FROM part""")
def comparison_codes(t):
    i = pick("p_partkey", "Acupuncture + usual care", "Acupuncture plus Usual care", "Acupuncture", "Acupuncture", "Acupuncture")
    c = pick("p_partkey", "Placebo and usual care", "usual care", "Sham needles", "Waiting list", "Exercise")
    return t.part.select("p_partkey", labels.comparison_code(i, c).alias("code"))


@query("pf23_footers", """SELECT doc_id, regexp_matches(lower(text), 'downloaded from|group\\.bmj\\.com|published by|copyright|all rights reserved|for personal use only') AS footer FROM documents""")
def footers(t):
    return t.documents.select("doc_id", labels.has_footer(F.col("text")).alias("footer"))


@query("pf26_modules", """SELECT o_orderkey, ['基础信息', 'STRICTA针灸', '偏倚风险', '统计结局', 'CONSORT流程', '整体'][(o_orderkey % 6 + 1)::INT] AS module FROM orders""")
def modules(t):
    path = pick("o_orderkey", "metadata.doi", "acupuncture.points[0]", "risk_of_bias", "outcomes[3].mean", "consort_flow.arms", "other.metadata")
    return t.orders.select("o_orderkey", labels.module_of(path).alias("module"))


@query("so23_transport_partitions", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'narrative-results' WHEN l_linenumber % 3 = 1 THEN 'table-' || l_linenumber ELSE 'figure ' || l_linenumber END AS key FROM lineitem""")
def transport_partitions(t):
    n = F.col("l_linenumber").cast("string")
    raw = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Narrative-results:p00"), n)).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit(" Table_00"), n, F.lit("#part-2:x"))).otherwise(F.concat(F.lit("Figure "), n))
    return t.lineitem.select("l_orderkey", "l_linenumber", labels.coverage_table_key(raw).alias("key"))


@query("st39_st40_contexts", """SELECT o_orderkey, ['FAS/ITT', 'PPS', 'NR', 'LOCF/MMRM'][(o_orderkey % 4 + 1)::INT] AS analysis, ['secondary', 'primary', 'administrative', 'NR'][(o_orderkey % 4 + 1)::INT] AS role FROM orders""")
def contexts(t):
    text = pick("o_orderkey", "TABLE_CATEGORY: Outcome\nitt and Full  Analysis Set", "per protocol\nthe Primary outcome", "x\nTABLE_CATEGORY: flow", "mixed model for repeated measures, LOCF")
    return t.orders.select("o_orderkey", labels.analysis_labels(text).alias("analysis"), labels.record_role(text).alias("role"))


@query("st26_st27_headers", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ' weeks' WHEN 1 THEN 'Baseline' WHEN 2 THEN 'T' || p_size ELSE 'NR' END AS time, CASE p_partkey % 4 WHEN 0 THEN 'Sham ' || p_brand WHEN 1 THEN p_brand || ' group' ELSE 'NR' END AS arm FROM part""")
def headers(t):
    size, at = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    time = F.when(at == 0, F.concat(F.lit("Mean at  "), size, F.lit(" weeks"))).when(at == 1, "Baseline value").when(at == 2, F.concat(F.lit("score T"), size)).otherwise("none")
    arm = F.when(at == 0, F.concat(F.lit("Sham  "), "p_brand")).when(at == 1, F.concat("p_brand", F.lit(" group"))).otherwise("SD")
    return t.part.select("p_partkey", labels.header_time(time).alias("time"), labels.header_arm(F.array(F.lit("mean"), arm)).alias("arm"))


@query("st33_row_cells", """SELECT s_suppkey, s_name || ' | ' || s_nationkey || ' | ' || s_suppkey AS cells FROM supplier""")
def row_cells(t):
    html = F.concat(F.lit("[ROW 3]<tr><td>"), "s_name", F.lit("</td><td> "), "s_nationkey", F.lit("  </td><td></td></tr>|"), "s_suppkey")
    return t.supplier.select("s_suppkey", F.array_join(labels.row_cells(html), " | ").alias("cells"))


@query("nm26_reported_counts", """SELECT p_partkey, p_partkey % 4 IN (0, 3) AS reported FROM part""")
def reported_counts(t):
    size, at = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    raw = F.when(at == 0, F.concat(F.lit("lost "), F.array_join(F.split(size, ""), " "), F.lit(" of all"))).when(at == 1, F.concat(F.lit("x"), size, F.lit(".5"))).when(at == 2, F.concat(F.lit("1"), size, F.lit(" left"))).otherwise("Eleven left")
    return t.part.select("p_partkey", labels.reports_count(F.when(at == 3, 11).otherwise(F.col("p_size")), raw).alias("reported"))


@query("nm24_nm25_status_keys", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'PRESENT ' || lower(c_mktsegment) ELSE 'NOT_REPORTED' END AS field, CASE WHEN c_custkey % 3 = 0 THEN 'PRESENT ' || lower(c_mktsegment) WHEN c_custkey % 3 = 1 THEN 'PRESENT ' || c_nationkey || ' weeks' ELSE 'NOT_REPORTED' END AS time FROM customer""")
def status_keys(t):
    at = F.col("c_custkey") % 3
    status, text = F.when(at == 0, "PRESENT").otherwise("NOT_REPORTED"), F.concat(F.lit(" "), "c_mktsegment", F.lit("  "))
    told = lambda k: F.concat_ws(" ", k["status"], k["value"])
    unit = F.when(at < 2, "Weeks")
    return t.customer.select("c_custkey", told(labels.status_key(status, text)).alias("field"), told(labels.time_key(status, text, F.when(at == 1, F.col("c_nationkey")), unit)).alias("time"))


@query("st20_split_names", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Mean' END AS statistic, 'after ' || p_size || ' weeks' AS time, 'mm' AS unit, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Mean ' || p_type END AS name FROM part""")
def split_names(t):
    said = F.concat(F.lit("Mean "), "p_type", F.lit(" after "), "p_size", F.lit(" weeks (mm)"))
    got = labels.split_name(said, F.when(F.col("p_partkey") % 2 == 1, "median"), F.lit("NR"), F.lit(None).cast("string"))
    return t.part.select("p_partkey", got.alias("g")).select("p_partkey", "g.statistic", "g.time", "g.unit", "g.name")


@query("st67_st68_formulas", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '\\frac parsed; ± unavailable' WHEN 1 THEN '$x_' || p_size || '$ parsed' ELSE '' END AS found FROM part""")
def formulas(t):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a \\frac b, 3 ± "), "p_size")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("so $x_"), "p_size", F.lit("$ holds"))).otherwise("plain")
    return t.part.select("p_partkey", F.array_join(F.transform(labels.formulas(text), lambda x: F.concat_ws(" ", x["raw"], x["status"])), "; ").alias("found"))


@query("nm08_intervals", """SELECT l_orderkey, l_linenumber, 0 - l_discount AS lower, l_quantity AS upper FROM lineitem""")
def intervals(t):
    low, high, at = (-F.col("l_discount")).cast("string"), F.col("l_quantity").cast("string"), F.col("l_linenumber") % 3
    minus = F.regexp_replace(low, "-", "−")
    told = F.when(at == 0, F.concat(F.lit("["), low, F.lit(", "), high, F.lit("]"))).when(at == 1, F.concat(F.lit('{"l": '), low, F.lit(', "upper": '), high, F.lit("}"))).otherwise(F.concat(F.lit("95 % CI "), minus, F.lit(" to "), high))
    told = F.when(at == 2, F.concat(minus, F.lit(" to "), high)).otherwise(told)
    got = labels.interval_of(told)
    return t.lineitem.select("l_orderkey", "l_linenumber", (got["lower"] + 0.0).alias("lower"), got["upper"].alias("upper"))


@query("nm13_primary_analysis", """SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 1 WHEN n_nationkey % 4 = 3 THEN 2 ELSE 4 END AS code FROM nation""")
def primary_analysis(t):
    code = F.when(F.col("n_nationkey") % 4 == 3, 2).otherwise(4)
    context = pick("n_nationkey", "The primary outcome: Intention-to-treat  analysis revealed", "intention-to-treat analysis revealed", "primary outcome", "primary outcome: intention-to-treat analysis revealed")
    return t.nation.select("n_nationkey", labels.primary_analysis(code, context).alias("code"))


@query("nm02_st74_means", """SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN p_size || '/' || (p_size + 1) END AS mean_sd, CASE p_partkey % 5 WHEN 0 THEN 'Mean (SD), n' WHEN 1 THEN 'Continuous data are presented as mean ± SD.' END AS cue FROM part""")
def means(t):
    at, size, more = F.col("p_partkey") % 5, F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")
    header = F.when(at == 0, "Mean (SD), n").when(at == 3, "Median").when(at == 4, "Mean and SD").otherwise("Score")
    cell = F.when(at == 0, F.concat(size, F.lit(" ("), more, F.lit(")"))).when(at == 1, F.concat(size, F.lit(" ± "), more)).when(at == 2, F.concat(size, F.lit(" ("), more, F.lit(")"))).when(at == 3, F.concat(size, F.lit(" ± "), more)).otherwise(F.concat(size, F.lit("% (3)")))
    said = labels.reporting_statements(F.lit("First. Continuous data are presented as mean ± SD.\nLast"))
    got = labels.mean_of(cell, header, said, F.lit("row"))
    return t.part.select("p_partkey", F.concat_ws("/", got["mean"], got["sd"]).alias("m"), got["cue"].alias("cue")).select("p_partkey", F.when(F.col("m") != "", F.col("m")).alias("mean_sd"), "cue")


@query("st07_st08_identities", """SELECT p_partkey, '["' || lower(p_name) || '","nr","week 4","itt","nr","nr","' || CASE WHEN lower(p_brand) < lower(p_type) THEN lower(p_brand) || '/control+' || lower(p_type) || '/nr' ELSE lower(p_type) || '/nr+' || lower(p_brand) || '/control' END || '"]' AS identity FROM part""")
def identities(t):
    arm = lambda i, label, role: F.struct(F.lit(i).cast("string").alias("arm_id") if not isinstance(i, Column) else i.alias("arm_id"), label.alias("label"), F.lit(role).cast("string").alias("role"))
    arms = F.array(arm(None, F.col("p_type"), "NR"), arm(F.col("p_brand"), F.lit("any"), " Control"))
    return t.part.select("p_partkey", labels.identity_of(F.col("p_name"), F.lit("n/a"), F.lit(" Week  4"), F.lit("ITT"), F.lit(None).cast("string"), F.lit(""), arms).alias("identity"))


@query("st69_st70_matrices", """SELECT p_partkey, '<table><tr><th>' || p_name || '</th><th>' || p_brand || '</th></tr><tr><td>' || p_size || '</td><td></td></tr></table>' AS html, 'C:' || p_name || '|C:' || p_brand || chr(10) || 'C:' || p_size AS otsl FROM part""")
def matrices(t):
    rows = F.array(F.array("p_name", "p_brand"), F.array(F.col("p_size").cast("string")))
    return t.part.select("p_partkey", labels.matrix_html(rows).alias("html"), labels.matrix_otsl(rows).alias("otsl"))


@query("st50_bibliography_headers", """SELECT s_suppkey, 'DOI=' || CASE WHEN s_suppkey % 2 = 0 THEN '10.1/' || s_suppkey ELSE 'NR' END || ' | YEAR=' || s_nationkey || ' | JOURNAL=' || s_name || ' | IMPACT_FACTOR=NR | CITATION_COUNT=' || s_suppkey || ' | RETRACTED=' || ['yes', 'no', 'NR'][(s_suppkey % 3 + 1)::INT] AS header FROM supplier""")
def bibliography_headers(t):
    doi = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("10.1/"), "s_suppkey"))
    gone = F.when(F.col("s_suppkey") % 3 < 2, F.col("s_suppkey") % 3 == 0)
    return t.supplier.select("s_suppkey", labels.bibliography_header(doi, F.col("s_nationkey"), F.col("s_name"), F.lit(None).cast("double"), F.col("s_suppkey"), gone).alias("header"))


@query("st14_same_contrasts", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN lower(p_brand) || ' vs ' || lower(p_type) END AS contrast FROM part""")
def same_contrasts(t):
    at = F.col("p_partkey") % 4
    one = lambda a, word, b, n: F.struct(F.concat(a, F.lit(f" {word} "), b).alias("value"), F.slice(F.array(F.lit("e")), 1, n).alias("evidence"))
    first, same = one(F.col("p_brand"), "vs.", F.col("p_type"), 1), one(F.upper("p_brand"), " vs", F.col("p_type"), 1)
    other = F.when(at == 1, one(F.col("p_type"), "vs", F.col("p_brand"), 1)).when(at == 2, one(F.col("p_brand"), "vs", F.col("p_type"), 0)).otherwise(same)
    return t.part.select("p_partkey", labels.same_contrast(F.when(at == 3, "PRESENT").otherwise("SOURCE_CONFLICT"), F.array(first, other)).alias("contrast"))


@query("aj05_aj06_checks", """SELECT c_custkey, c_custkey % 2 = 0 AS hash_holds, c_custkey % 3 = 0 AS ids_valid FROM customer""")
def checks(t):
    stated = F.when(F.col("c_custkey") % 2 == 0, F.sha2("c_name", 256)).otherwise(F.sha2("c_mktsegment", 256))
    ids = F.when(F.col("c_custkey") % 3 == 0, F.array("c_name", "c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.array("c_name", "c_name")).otherwise(F.array("c_name", F.lit("")))
    return t.customer.select("c_custkey", labels.self_hash_holds(F.col("c_name"), stated).alias("hash_holds"), labels.valid_ids(ids).alias("ids_valid"))


@query("pf19_source_signals", """SELECT l_orderkey, l_linenumber, l_linenumber % 5 <> 0 AS signal FROM lineitem""")
def source_signals(t):
    at = F.col("l_linenumber") % 5
    some = lambda k: F.slice(F.array(F.lit("e")), 1, (at == k).cast("int"))
    raw = F.when(at == 0, " Not Reported ").when(at == 4, "about three").otherwise("NR")
    return t.lineitem.select("l_orderkey", "l_linenumber", labels.source_signal(F.when(at == 1, F.col("l_tax")), some(2), some(3), raw).alias("signal"))


@query("st54_first_matches", """SELECT page_id, nullif(regexp_extract(url, 'https?://([^/]+)', 1), '') AS host FROM pages""")
def first_matches(t):
    return t.pages.select("page_id", labels.first_match(F.col("url"), r"https?://([^/]+)").alias("host"))
