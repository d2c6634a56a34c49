"""Queries over approximate titles and over paragraphs that speak of something."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import narratives, titles

from .registry import query


@query("sc28_title_lookup")
def title_lookup(t):
    """Titles of every twentieth document, two letters swapped and one dropped, looked up among those of all documents; one in five has a DOI."""
    docs = t.documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.substring(F.coalesce("text", F.lit("")), 1, 80).alias("title"), F.concat(F.lit("10.1/D"), F.col("doc_id").cast("string")).alias("doi"))
    worse = F.concat(F.substring("title", 1, 10), F.substring("title", 12, 1), F.substring("title", 11, 1), F.substring("title", 13, 20), F.substring("title", 34, 80))
    wanted = docs.filter("id % 20 = 0").select("id", worse.alias("title"), F.when(F.col("id") % 100 == 0, F.lower("doi")).alias("doi"))
    return titles.lookup(wanted, docs).select("id", "rank", "method", "key", F.round("score", 6).alias("score"), "error")


@query("st38_relevant_paragraphs", r"""WITH p AS (SELECT lower(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_extract(text, '^\S+ \S+ \S+ \S+'), '[^A-Za-z0-9%/_ \-]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: w <> '' AND lower(w) NOT IN ('table', 'the', 'and', 'group', 'groups', 'mean', 'sd', 'value', 'baseline', 'follow', 'treatment', 'control', 'after', 'from', 'with', 'for', 'were', 'was', 'this', 'that', 'data', 'change', 'difference', 'score', 'total', 'number', 'patients', 'participants')), ' ')) AS phrase, item_id % 2 AS study FROM benchmark),
d AS (SELECT doc_id AS id, doc_id % 2 AS study, text, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '' AND NOT (x LIKE '|%' AND x LIKE '%|')) AS ps FROM documents),
u AS (SELECT id, study, unnest(ps) AS x, unnest(range(len(ps))) AS place FROM d), m AS (SELECT id, x, min(place) AS place FROM u WHERE EXISTS (SELECT 1 FROM p WHERE p.study = u.study AND length(p.phrase) >= 5 AND contains(lower(x), p.phrase)) GROUP BY id, x),
j AS (SELECT id, count(*) AS n, string_agg(x, chr(10) || chr(10) ORDER BY place) AS matched FROM m GROUP BY id)
SELECT id, md5(CASE WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN '' WHEN n > 0 THEN matched WHEN length(text) <= 12000 AND len(ps) > 0 THEN array_to_string(ps, chr(10) || chr(10)) ELSE 'No directly matched Results narrative paragraph; use the supplied table evidence only.' END) AS narrative, coalesce(n, 0) AS n_relevant FROM d LEFT JOIN j USING (id)""")
def relevant_paragraphs(t):
    """Paragraphs of documents that hold the first words of a benchmark item of their half, by a digest of the narrative."""
    phrase = narratives.row_phrase(F.regexp_extract("text", r"^\S+ \S+ \S+ \S+", 0))
    phrases = t.benchmark.select((F.col("item_id") % 2).alias("study"), phrase.alias("phrase"))
    docs = t.documents.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).alias("study"), "text")
    return narratives.relevant(docs, phrases, "study").select("id", F.md5("narrative").alias("narrative"), "n_relevant")
