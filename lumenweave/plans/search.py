"""Queries over stored tables: an inverted index, keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions.text import tokens
from lumenweave.operators import answers, inverted, retrieval
from lumenweave.plans.registry import query
from lumenweave.plans.sequences import BM25, TERMS, VEC
from lumenweave.shared import fresh_path
from lumenweave.sources.keyed import KeyedTable

WORDS = "w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) > 1) AS w FROM documents)"


def stored_index(docs) -> str:
    """An index in the shared folder, put together from two batches of documents as they might arrive."""
    path = fresh_path(docs.sparkSession, "index")
    for part in (0, 1):
        inverted.append(docs.filter(F.pmod("doc_id", F.lit(2)) == part), path)
    return path


@query("tk02_postings", f"WITH {WORDS}, e AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY doc_id, term) SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf, max(tf)::INT AS max_tf FROM e GROUP BY term")
def postings(t):
    """The whole vocabulary as the index holds it: in how many documents a term occurs, how often, and at most how often in one."""
    docs = t.documents
    return inverted.vocabulary(docs.sparkSession, stored_index(docs))


QUESTIONS = {"rights": ["licensed", "public", "rights", "public"], "words": ["the", "and", "ring"], "none": ["qqqqq"]}
ASKED = " UNION ALL ".join(f"SELECT '{name}' AS question, '{term}' AS term, {words.count(term)} AS times" for name, words in QUESTIONS.items() for term in sorted(set(words)))


@query("tk02_tk12_indexed_search", f"""WITH {WORDS}, s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w), q AS ({ASKED}),
h AS (SELECT doc_id, len(w) AS l, question, term, times, len(list_filter(w, lambda x: x = term)) AS tf FROM w, q), d AS (SELECT question, term, count(*) FILTER (tf > 0) AS df FROM h GROUP BY question, term),
b AS (SELECT question, doc_id, round(sum(times * ln((n - df + 5e-1) / (df + 5e-1) + 1e0) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * l / a))), 6) AS score FROM h JOIN d USING (question, term), s GROUP BY question, doc_id HAVING sum(tf) > 0)
SELECT question, doc_id, score FROM b QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) <= 20""")
def indexed_search(t):
    """Several questions to one index, the first 20 documents each; no question reads the texts."""
    docs = t.documents
    spark, path, out = docs.sparkSession, stored_index(docs), None
    for name, words in QUESTIONS.items():
        found = inverted.search(spark, path, words, 20).select(F.lit(name).alias("question"), F.col("doc").alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    return out


POOLED = f"""WITH {BM25}, {VEC}, qv AS (SELECT (('0x' || substr(md5(term), 1, 8))::BIGINT) % 256 AS d, times::DOUBLE AS n FROM q), ql AS (SELECT sqrt(sum(n * n)) AS len FROM qv),
k AS (SELECT doc_id, sum(c.n * qv.n) / any_value(z.len) / any_value(ql.len) AS cos FROM c JOIN qv USING (d) JOIN z USING (doc_id), ql GROUP BY doc_id),
p AS (SELECT doc_id, round(score, 6) AS initial FROM b WHERE score > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT 60)
SELECT coalesce(source, 'NR') || '/' || doc_id AS citation_id, initial, round(least(1, greatest(0, cos)), 6) AS score FROM p JOIN k USING (doc_id) JOIN documents USING (doc_id) WHERE cos >= 2e-2 ORDER BY round(least(1, greatest(0, cos)), 6) DESC, initial DESC, doc_id LIMIT 10"""


@query("tk04_tk13_pool_rerank", POOLED)
def pool_rerank(t):
    """A pool of 60 from the index, scored again by hashed vectors; what is not near goes, and the ten best are cited by source.

    Only the pool's texts are read a second time.
    """
    docs = t.documents
    pool = inverted.search(docs.sparkSession, stored_index(docs), TERMS, 60).select(F.col("doc").alias("doc_id"), F.col("score").alias("initial"))
    held = docs.select("doc_id", "source", "text").join(F.broadcast(pool), "doc_id")
    cos = retrieval.hashed_cosine(retrieval.hashed_places(tokens(F.col("text"))), TERMS)
    again = answers.rerank(held.select("doc_id", "source", "initial", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("double").alias("score"), cos.alias("cos")).filter("cos >= 0.02"), F.round("cos", 6))
    best = retrieval.top_k(again, 10, F.desc("score"), F.desc("initial"), F.asc("doc_id"))
    return best.select(F.concat_ws("/", F.coalesce("source", F.lit("NR")), F.col("doc_id").cast("string")).alias("citation_id"), "initial", "score")


@query("sk02_sk03_bucketed_upsert", """SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 7 THEN 'changed' WHEN o_orderkey % 50 = 3 THEN 'late' ELSE o_orderstatus END AS state, CASE WHEN o_orderkey % 100 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders
UNION ALL SELECT -o_orderkey, 'new', o_totalprice FROM orders WHERE o_orderkey % 100 = 7""")
def bucketed_upsert(t):
    """All orders as a keyed table; then one percent of them changed and as many added, and last of two rows a key the later."""
    orders = t.orders
    table = KeyedTable(orders.sparkSession, fresh_path(orders.sparkSession, "keyed"), ["o_orderkey"])
    row = lambda df, key, state, price, at: df.select(key.alias("o_orderkey"), state.alias("state"), price.alias("price"), F.lit(at).alias("at"))
    key, state, price = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice")
    table.upsert(row(orders, key, state, price, 0))
    some = orders.filter("o_orderkey % 100 = 7")
    table.upsert(row(some, key, F.lit("changed"), price + 1, 1).unionByName(row(some, -key, F.lit("new"), price, 1)))
    late = orders.filter("o_orderkey % 50 = 3")
    table.upsert(row(late, key, F.lit("late"), price, 3).unionByName(row(late, key, F.lit("early"), price, 2)), order=["at"])
    return table.read().select("o_orderkey", "state", "price")
