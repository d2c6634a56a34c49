"""Queries over texts and pages: parsing, routing, tables, scalars, hashes, JSON, sharded extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import numbers, text
from lumenweave.operators import documents, extraction

from .registry import query

C = r"regexp_replace(trim(regexp_replace({}, '\s+', ' ', 'g')), '^ | $', '', 'g')"


@query("sc06_sc07_profile_and_route", r"""SELECT doc_id, n_chars, n_words, n_digits, n_bars, n_lines, reasons, CASE WHEN reasons = '' THEN 'plain' WHEN reasons LIKE '%table_heavy%' THEN 'tables' ELSE 'review' END AS route FROM (
SELECT *, array_to_string(list_filter([CASE WHEN n_words < 20 THEN 'too_short' END, CASE WHEN n_bars / greatest(n_chars, 1) > 1e-2 THEN 'table_heavy' END, CASE WHEN n_digits / greatest(n_chars, 1) > 2e-1 THEN 'digit_heavy' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (
SELECT doc_id, length(text) AS n_chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, length(regexp_replace(text, '[^|]', '', 'g')) AS n_bars, len(string_split(text, chr(10))) AS n_lines FROM documents))""")
def profile_and_route(t):
    return documents.profile(t.documents, "doc_id", "text")


@query("pf02_pf10_repeated_lines", """WITH l AS (SELECT source, doc_id, lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS k FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)),
o AS (SELECT source, k, count(DISTINCT doc_id) AS n FROM l GROUP BY source, k), p AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source)
SELECT source, count(*) AS n_lines, count(*) FILTER (k = '' OR regexp_matches(k, '^(page )?[0-9]+$') OR regexp_matches(k, '^(?:accepted manuscript|copyright|doi:\\s*10\\.|www\\.|preprint)\\b') OR (o.n >= greatest(3, ceil(6e-1 * p.n)) AND length(k) < 180)) AS n_boilerplate FROM l JOIN o USING (source, k) JOIN p USING (source) GROUP BY source""")
def repeated_lines(t):
    blocks = t.documents.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("content"))
    judged = documents.boilerplate(blocks, "source", "doc_id", "content")
    return judged.groupBy("source").agg(F.count("*").alias("n_lines"), F.count_if("is_boilerplate").alias("n_boilerplate"))


@query("pf04_pf12_rule_classifier", """SELECT doc_id, CASE WHEN x LIKE '%licen%' THEN 'license' WHEN x LIKE '%rights reserved%' THEN 'rights' WHEN x LIKE '%@%' THEN 'contact' ELSE 'unknown' END AS kind FROM (SELECT doc_id, lower(substr(text, 1, 500)) AS x FROM documents)""")
def rule_classifier(t):
    rules = [("license", ["licen"]), ("rights", ["rights reserved"]), ("contact", ["@"])]
    return t.documents.select("doc_id", text.keyword_category(F.substring("text", 1, 500), rules, "unknown").alias("kind"))


@query("pf06_pf09_chunk_filter", """SELECT doc_id, source, substr(text, 1, 40) AS quote FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')""")
def chunk_filter(t):
    return t.documents.filter("lang = 'en' AND source IN ('src1', 'src2')").select("doc_id", "source", F.substring("text", 1, 40).alias("quote"))


@query("pf16_pf18_value_blind_projection", """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders""")
def value_blind_projection(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("pf29_review_queue", """SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS review_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0 OR n_chars < 100""")
def review_queue(t):
    from lumenweave.operators.numbering import dense_numbers

    queue = t.documents.join(t.labels, "doc_id").filter("quality = 0 OR n_chars < 100").select("doc_id")
    return dense_numbers(queue, "review_id", "doc_id")


@query("sc22_wn11_page_headings", """SELECT page_id, place, level, heading FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h([1-3])[^>]*>', 1)) AS level, generate_subscripts(regexp_extract_all(html, '<h([1-3])[^>]*>', 1), 1) - 1 AS place,
unnest(list_transform(regexp_extract_all(html, '<h[1-3][^>]*>([^<]*)</h[1-3]>', 1), lambda x: trim(x))) AS heading FROM pages) WHERE level IS NOT NULL AND heading IS NOT NULL""")
def page_headings(t):
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit("<h([1-3])[^>]*>"), 1).alias("level"), F.transform(F.regexp_extract_all("html", F.lit("<h[1-3][^>]*>([^<]*)</h[1-3]>"), 1), lambda x: F.trim(x)).alias("heading"))
    return t.pages.select("page_id", F.posexplode(found).alias("place", "x")).select("page_id", "place", "x.level", "x.heading").filter("level IS NOT NULL AND heading IS NOT NULL")


@query("st22_visible_text", r"""SELECT page_id, length(x) AS n, md5(x) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&minus;', '-'), '&plusmn;', '±'), '&amp;', '&'), '[−–—]', '-', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS x FROM pages)""")
def visible_text(t):
    x = documents.visible_text(F.col("html"))
    return t.pages.select("page_id", F.length(x).alias("n"), F.md5(x).alias("digest"))


@query("st02_st17_text_keys", r"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lower(c_name) END AS k, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS word_key, array_to_string(list_filter(regexp_extract_all(lower(c_name), '[a-z0-9]+'), lambda x: length(x) > 1), '|') AS tokens,
coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_name END, c_mktsegment) AS first_reported FROM customer""")
def text_keys(t):
    name = F.when(F.col("c_custkey") % 5 == 0, F.get(F.array(*[F.lit(x) for x in ("NR", " n/a ", "", "None")]), (F.col("c_custkey") % 4).cast("int"))).otherwise(F.col("c_name"))
    return t.customer.select(
        "c_custkey", text.key(name).alias("k"), text.word_key(F.col("c_name")).alias("word_key"), F.array_join(text.tokens(F.col("c_name")), "|").alias("tokens"), text.first_reported(name, F.col("c_mktsegment")).alias("first_reported")
    )


@query("st12_st21_contrasts", """SELECT p_partkey, a || ' / ' || b AS sides, s AS subject, 'rate' AS kind FROM (SELECT p_partkey, p_brand AS a, p_type AS b, p_type AS s FROM part)""")
def contrasts(t):
    surface = F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, " vs. ").otherwise(" versus "), "p_type")
    unwrapped = text.unwrap_statistic(F.concat(F.lit("Rate of "), "p_type"))
    return t.part.select("p_partkey", F.array_join(text.contrast_sides(surface), " / ").alias("sides"), unwrapped["subject"].alias("subject"), unwrapped["kind"].alias("kind"))


@query("st45_st48_contacts", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+\.[a-z]{2,}'))), ',') AS emails FROM documents""")
def contacts(t):
    """Mail addresses of every document; empty where it has none."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9._%+-]+@[a-z0-9-]+\.[a-z]{2,}"), 0)
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("emails"))


@query("nm01_nm15_p_values", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN '<' ELSE '=' END AS operator, round(l_discount, 2) AS value FROM lineitem""")
def p_values(t):
    shown = F.format_number(F.round("l_discount", 2), 2)
    surface = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("P < "), shown)).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("p="), shown)).otherwise(shown)
    p = numbers.p_value(surface)
    return t.lineitem.select("l_orderkey", "l_linenumber", p["operator"].alias("operator"), p["value"].alias("value"))


@query("nm06_nm07_pairs", """SELECT l_orderkey, l_linenumber, l_quantity AS mean, l_linenumber::DOUBLE AS sd, l_linenumber::DOUBLE AS lower, l_quantity + 10 AS upper FROM lineitem""")
def pairs(t):
    q, n = F.col("l_quantity").cast("string"), F.col("l_linenumber").cast("string")
    m = numbers.mean_sd(F.when(F.col("l_linenumber") % 2 == 0, F.concat(q, F.lit(" ("), n, F.lit(")"))).otherwise(F.concat(q, F.lit(" ± "), n)))
    i = numbers.interval(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "95% CI: ").otherwise(""), n, F.lit(" to "), (F.col("l_quantity") + 10).cast("string")))
    return t.lineitem.select("l_orderkey", "l_linenumber", m["mean"].alias("mean"), m["sd"].alias("sd"), i["lower"].alias("lower"), i["upper"].alias("upper"))


@query("nm09_nm30_first_numbers", r"""SELECT page_id, nullif(regexp_extract(url, '([-+]?[0-9]+(?:\.[0-9]+)?)', 1), '')::DOUBLE AS n FROM pages""")
def first_numbers(t):
    return t.pages.select("page_id", numbers.first_number(F.col("url")).alias("n"))


@query("nm19_nm20_timepoints", """SELECT p_partkey, p_size::DOUBLE AS value, ['day', 'week', 'month', 'year'][(p_partkey % 4 + 1)::INT] AS unit, CASE WHEN p_partkey % 3 = 0 THEN 'COMPATIBLE' WHEN p_partkey % 3 = 1 THEN 'EXACT' ELSE 'CONTRADICTORY' END AS against FROM part""")
def timepoints(t):
    unit = F.get(F.array(*[F.lit(u) for u in ("day", "week", "month", "year")]), (F.col("p_partkey") % 4).cast("int"))
    size = F.col("p_size").cast("string")
    plain = numbers.timepoint(F.concat(size, F.lit(" "), unit, F.lit("s")))
    other = numbers.timepoint(F.when(F.col("p_partkey") % 3 == 0, F.concat(unit, F.lit("s "), size, F.lit(" after surgery"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("at the "), size, F.lit("th "), unit)).otherwise(F.concat(size, F.lit(" hours"))))
    both = t.part.select("p_partkey", plain.alias("a"), other.alias("b"))
    return both.select("p_partkey", "a.value", "a.unit", numbers.compare_timepoints(F.col("a"), F.col("b")).alias("against"))


@query("nm29_nm31_codes_and_scores", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code, CASE WHEN v > 0 AND v < 1 THEN v * 100 WHEN v >= 0 AND v <= 100 THEN v END AS score FROM (SELECT *, (o_orderkey % 13)::DOUBLE * CASE WHEN o_orderkey % 2 = 0 THEN 5e-2 ELSE 15 END AS v FROM orders)""")
def codes_and_scores(t):
    v = (F.col("o_orderkey") % 13).cast("double") * F.when(F.col("o_orderkey") % 2 == 0, F.lit(0.05)).otherwise(F.lit(15.0))
    return t.orders.select("o_orderkey", numbers.codebook(F.col("o_orderstatus"), {"F": 1, "O": 2}).alias("code"), numbers.percent_score(v).alias("score"))


@query("aj01_aj04_content_ids", """SELECT doc_id, substr(sha256('{"doc":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}'), 1, 24) AS id, md5(text) AS digest FROM documents""")
def content_ids(t):
    from lumenweave.functions.ids import canonical_json

    body = canonical_json(doc=F.col("doc_id"), lang=F.col("lang"), source=F.col("source"))
    return t.documents.select("doc_id", F.substring(F.sha2(body, 256), 1, 24).alias("id"), F.md5("text").alias("digest"))


@query("pf25_aj09_flatten_json", """SELECT event_id, k AS path, json_extract_string(props, '$."' || k || '"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def flatten_json(t):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))


@query("pl02_pl03_sharded_extraction", """SELECT doc_id, count(*) AS n_rows, count(*) FILTER (length(x) >= 20) AS n_extracted, count(*) FILTER (length(x) < 20) AS n_skipped, CASE WHEN count(*) FILTER (length(x) > 400) > 0 AND count(*) FILTER (length(x) >= 20) > 1 THEN 'retried' ELSE 'first' END AS mode FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY doc_id""")
def sharded_extraction(t):
    """Lines of each document through an extractor that fails on long shards; what it left out is retried singly."""
    rows = documents.lines(t.documents, "doc_id", "text")
    done = extraction.sharded(rows.filter(F.length("content") >= 20), "doc_id", "line", "content")
    per_doc = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count_if(F.length("content") < 20).alias("n_skipped"))
    got = done.groupBy("doc_id").agg(F.count("*").alias("n_extracted"), F.max((F.col("mode") == "retried").cast("int")).alias("r"))
    out = per_doc.join(got, "doc_id", "left")
    return out.select("doc_id", "n_rows", F.coalesce("n_extracted", F.lit(0)).alias("n_extracted"), "n_skipped", F.when(F.col("r") == 1, "retried").otherwise("first").alias("mode"))


@query("st01_nfkc_casefold")
def nfkc_casefold(t):
    return t.documents.select("doc_id", F.md5(text.nfkc_casefold(F.col("text"))).alias("digest"))


@query("sc10_sc17_markdown_round_trip")
def markdown_round_trip(t):
    """Documents with page markers and headings put in, routed into sections, and written as Markdown again."""
    marked = t.documents.select("doc_id", F.concat(F.lit("<!-- page 1 -->\n# Abstract\n"), "text", F.lit("\n<!-- page 2 -->\n## Statistical methods\n| a | b |\n| --- | --- |\n| 1 | 2 |\n# Unknown words\nmore")).alias("text"))
    rows = documents.routed(marked, "doc_id", "text").filter("kind IN ('text', 'table')")
    return documents.markdown(rows, "doc_id").select("doc_id", F.md5("markdown").alias("digest"), F.length("markdown").alias("n"))


@query("sc05_wn11_pipe_tables", """SELECT p_partkey AS doc, 'table-1' AS table_id, 0 AS row, c AS col, ['Name', 'Brand', 'Size'][c + 1] AS header, [p_name, p_brand, p_size::VARCHAR][c + 1] AS cell FROM part, (SELECT unnest([0, 1, 2]) AS c)""")
def pipe_tables(t):
    """Cells of a pipe table made of every part: a header, its rule, a row."""
    made = t.part.select(F.col("p_partkey").alias("doc"), F.concat(F.lit("# Results\n| Name | Brand | Size |\n| --- | --- | --- |\n| "), F.concat_ws(" | ", "p_name", "p_brand", "p_size"), F.lit(" |\n")).alias("text"))
    found = documents.cells(documents.pipe_tables(documents.routed(made, "doc", "text"), "doc"), "doc")
    return found
