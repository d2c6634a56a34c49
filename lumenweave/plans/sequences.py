"""Order-dependent queries: islands, surrogate ids, stages; set algebra and stability across runs; top-k retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenweave.functions import numbers
from lumenweave.operators import matching, merging, retrieval

from .registry import query


@query("wn01_gaps_and_islands", """SELECT user_id, island, count(*) AS n, min(event_id) AS first_id, max(epoch_us(ts)) - min(epoch_us(ts)) AS span_us FROM (
SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (
SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 99999999999) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, island""")
def gaps_and_islands(t):
    """Events of a user stay one island while no gap is over six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    marked = t.events.withColumn("us", us).withColumn("fresh", (F.coalesce(F.col("us") - F.lag("us").over(w), F.lit(99999999999)) > 21600000000).cast("int"))
    islands = marked.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), (F.max("us") - F.min("us")).alias("span_us"))


@query("wn01_turn_stitching", """SELECT conv_id, block, min(role) AS role, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM (
SELECT *, sum(CASE WHEN role IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM (
SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) AS p FROM conversations)) GROUP BY conv_id, block""")
def turn_stitching(t):
    """Turns in a row of one role become a block."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    marked = t.conversations.withColumn("p", F.lag("role").over(w)).withColumn("fresh", (~F.col("role").eqNullSafe(F.col("p"))).cast("int"))
    blocks = marked.withColumn("block", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return blocks.groupBy("conv_id", "block").agg(F.min("role").alias("role"), F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


@query("wn03_surrogate_ids", """SELECT l_orderkey, l_suppkey, 'O' || lpad((dense_rank() OVER (PARTITION BY l_orderkey ORDER BY f))::VARCHAR, 2, '0') AS id FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS f FROM lineitem GROUP BY l_orderkey, l_suppkey)""")
def surrogate_ids(t):
    """Ids number an order's suppliers by first appearance."""
    first = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("f"))
    n = F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("f"))
    return first.select("l_orderkey", "l_suppkey", F.concat(F.lit("O"), F.lpad(n.cast("string"), 2, "0")).alias("id"))


@query("wn04_guarded_natural_keys", """SELECT k, count(*) AS n FROM (SELECT CASE WHEN event_type = 'click' THEN 'row:' || event_id WHEN value > 50 THEN 'v:' || floor(value)::BIGINT ELSE 'u:' || user_id END AS k FROM events) GROUP BY k""")
def guarded_natural_keys(t):
    """Rows whose scope is unknown get a key of their own and never merge."""
    key = F.when(F.col("event_type") == "click", F.concat(F.lit("row:"), "event_id")).when(F.col("value") > 50, F.concat(F.lit("v:"), F.floor("value"))).otherwise(F.concat(F.lit("u:"), "user_id"))
    return t.events.groupBy(key.alias("k")).agg(F.count("*").alias("n"))


@query("wn07_first_spelling", """SELECT k, s AS first_spelling, n FROM (SELECT lower(p_type) AS k, arg_min(p_type, p_partkey) AS s, count(*) AS n FROM part GROUP BY lower(p_type))""")
def first_spelling(t):
    return t.part.groupBy(F.lower("p_type").alias("k")).agg(F.min_by("p_type", "p_partkey").alias("first_spelling"), F.count("*").alias("n"))


@query("wn08_rank_by_offset", """SELECT doc_id, word, rank() OVER (PARTITION BY doc_id ORDER BY p) AS place FROM (SELECT doc_id, word, strpos(lower(text), word) AS p FROM documents, (SELECT unnest(['copyright', 'licensed', 'rights', 'reserved', 'email']) AS word)) WHERE p > 0""")
def rank_by_offset(t):
    lower = t.documents.select("doc_id", F.lower("text").alias("x"))
    places = F.array(*[F.struct(F.lit(w).alias("word"), F.instr("x", w).alias("p")) for w in ("copyright", "licensed", "rights", "reserved", "email")])
    placed = lower.select("doc_id", F.explode(F.filter(places, lambda x: x["p"] > 0)).alias("w")).select("doc_id", "w.*")
    return placed.select("doc_id", "word", F.rank().over(Window.partitionBy("doc_id").orderBy("p")).alias("place"))


@query("wn09_consecutive_prefix", """SELECT l_orderkey, count(*) FILTER (NOT broken) AS n_prefix, count(*) FILTER (broken) AS n_rest FROM (SELECT l_orderkey, bool_or(l_quantity < 10) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS broken FROM lineitem) GROUP BY l_orderkey""")
def consecutive_prefix(t):
    """A run from the first row until a row that does not belong."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    broken = F.bool_or(F.col("l_quantity") < 10).over(w)
    return t.lineitem.select("l_orderkey", broken.alias("broken")).groupBy("l_orderkey").agg(F.count_if(~F.col("broken")).alias("n_prefix"), F.count_if("broken").alias("n_rest"))


@query("wn13_longest_time", """SELECT p_brand, max(p_size * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 30 ELSE 365 END)::BIGINT AS days FROM part GROUP BY p_brand""")
def longest_time(t):
    unit = F.get(F.array(*[F.lit(u) for u in ("day", "week", "month", "year")]), (F.col("p_partkey") % 4).cast("int"))
    return t.part.groupBy("p_brand").agg(F.max(numbers.in_days(F.col("p_size"), unit)).cast("long").alias("days"))


@query("wn14_first_failing_stage", """SELECT user_id, CASE WHEN count(DISTINCT event_type) < 4 THEN 'UNKNOWN' ELSE arg_min(event_type, ts) END AS first_failure FROM (SELECT user_id, event_type, min(ts) AS ts FROM events WHERE value > 60 GROUP BY user_id, event_type) GROUP BY user_id""")
def first_failing_stage(t):
    """The earliest stage that failed, known only where all stages left a trace."""
    first = t.events.filter("value > 60").groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"))
    return first.groupBy("user_id").agg(F.when(F.count("*") < 4, "UNKNOWN").otherwise(F.min_by("event_type", "ts")).alias("first_failure"))


@query("wn15_last_state", """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type""")
def last_state(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query("wn16_wn18_first_change", """SELECT user_id, min(n) AS first_change FROM (SELECT user_id, event_type, row_number() OVER w AS n, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE p <> event_type GROUP BY user_id""")
def first_change(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = t.events.select("user_id", "event_type", F.row_number().over(w).alias("n"), F.lag("event_type").over(w).alias("p"))
    return seen.filter("p <> event_type").groupBy("user_id").agg(F.min("n").alias("first_change"))


@query("wn05_detail_over_row", """SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, o_orderstatus) AS state FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def detail_over_row(t):
    both = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("l_orderkey", "l_linenumber", F.coalesce(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")), F.col("o_orderstatus")).alias("state"))


RUNS = "r AS (SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS run, user_id AS k FROM events WHERE event_type = 'purchase')"


def runs(t):
    run = F.when(F.col("event_id") % 3 == 0, "a").when(F.col("event_id") % 3 == 1, "b").otherwise("c")
    return t.events.filter("event_type = 'purchase'").select(run.alias("run"), F.col("user_id").alias("k")).distinct()


@query("so01_set_stability", f"""WITH {RUNS}, p AS (SELECT * FROM (VALUES ('a', 'b'), ('a', 'c'), ('b', 'c')) v(x, y))
SELECT x, y, count(*) FILTER (l AND g) AS overlap, count(*) AS union_size, round(coalesce(count(*) FILTER (l AND g)::DOUBLE / nullif(count(*), 0), 1), 6) AS jaccard, count(*) FILTER (l AND NOT g) AS only_left, count(*) FILTER (g AND NOT l) AS only_right
FROM (SELECT x, y, k, bool_or(run = x) AS l, bool_or(run = y) AS g FROM r JOIN p ON run IN (x, y) GROUP BY x, y, k) GROUP BY x, y""")
def set_stability(t):
    """Pairwise overlaps of three runs' sets; each member is aggregated once with the runs that have it."""
    has = runs(t).groupBy("k").agg(F.collect_set("run").alias("in"))
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ("ab", "ac", "bc")])).alias("p")
    both = has.select("in", pairs).select(F.col("p.x"), F.col("p.y"), F.expr("array_contains(in, p.x)").alias("l"), F.expr("array_contains(in, p.y)").alias("g")).filter("l OR g")
    n = lambda c: F.count_if(F.expr(c))
    return both.groupBy("x", "y").agg(
        n("l AND g").alias("overlap"), F.count("*").alias("union_size"), F.round(n("l AND g") / F.count("*"), 6).alias("jaccard"), n("l AND NOT g").alias("only_left"), n("g AND NOT l").alias("only_right")
    )


@query("so04_presence_counts", f"WITH {RUNS} SELECT n_runs, count(*) AS n FROM (SELECT k, count(*) AS n_runs FROM r GROUP BY k) GROUP BY n_runs")
def presence_counts(t):
    return runs(t).groupBy("k").agg(F.count("*").alias("n_runs")).groupBy("n_runs").agg(F.count("*").alias("n"))


@query("so05_so08_nway_compare", """WITH v AS (SELECT user_id, arg_max(floor(value / 25)::BIGINT, event_id) FILTER (event_id % 3 = 0) AS a, arg_max(floor(value / 25)::BIGINT, event_id) FILTER (event_id % 3 = 1) AS b, arg_max(floor(value / 25)::BIGINT, event_id) FILTER (event_id % 3 = 2) AS c FROM events WHERE event_type = 'refund' OR event_type = 'purchase' GROUP BY user_id)
SELECT user_id, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'MISSING_IN_ONE_RUN' WHEN a = b AND b = c THEN 'SAME' ELSE 'DIFFERENT' END AS drift FROM v""")
def nway_compare(t):
    """A slot's value in three runs; the last write of a run counts."""
    rows = t.events.filter("event_type IN ('refund', 'purchase')").withColumn("v", F.floor(F.col("value") / 25))
    last = [F.max_by(F.when(F.col("event_id") % 3 == i, F.col("v")), F.when(F.col("event_id") % 3 == i, F.col("event_id"))).alias(x) for i, x in enumerate("abc")]
    return rows.groupBy("user_id").agg(*last).select("user_id", F.expr("CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'MISSING_IN_ONE_RUN' WHEN a = b AND b = c THEN 'SAME' ELSE 'DIFFERENT' END").alias("drift"))


@query("so09_so24_contract_diff", """WITH a AS (SELECT n_nationkey AS k, n_name AS x, n_regionkey AS y FROM nation), b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN upper(n_name) || '!' ELSE n_name END AS x, CASE WHEN n_nationkey % 7 <> 0 THEN n_regionkey END AS y FROM nation WHERE n_nationkey <> 3)
SELECT k, CASE WHEN a.x IS NULL OR b.x IS NULL THEN 'NOT_AVAILABLE' WHEN a.x = b.x THEN 'SAME' ELSE 'DIFFERENT' END AS name, CASE WHEN a.y IS NULL OR b.y IS NULL THEN 'NOT_AVAILABLE' WHEN a.y = b.y THEN 'SAME' ELSE 'DIFFERENT' END AS region FROM a FULL JOIN b USING (k)""")
def contract_diff(t):
    a = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("x"), F.col("n_regionkey").alias("y"))
    b = a.filter("k <> 3").select("k", F.when(F.col("k") % 5 == 0, F.concat(F.upper("x"), F.lit("!"))).otherwise(F.col("x")).alias("x2"), F.when(F.col("k") % 7 != 0, F.col("y")).alias("y2"))
    state = lambda p, q: F.when(F.col(p).isNull() | F.col(q).isNull(), "NOT_AVAILABLE").when(F.col(p) == F.col(q), "SAME").otherwise("DIFFERENT")
    return a.join(b, "k", "full").select("k", state("x", "x2").alias("name"), state("y", "y2").alias("region"))


@query("so10_so11_keep_first", """SELECT k, arg_min(src, (src, id)) AS src, arg_min(id, (src, id)) AS id FROM (SELECT n_regionkey AS k, 'a' AS src, n_nationkey AS id FROM nation UNION ALL SELECT s_nationkey % 9, 'b', s_suppkey FROM supplier) GROUP BY k""")
def keep_first(t):
    rows = t.nation.select(F.col("n_regionkey").alias("k"), F.lit("a").alias("src"), F.col("n_nationkey").cast("long").alias("id")).union(t.supplier.select(F.col("s_nationkey") % 9, F.lit("b"), "s_suppkey"))
    return merging.keep_first(rows, ["k"], [F.col("src"), F.col("id")]).select("k", "src", "id")


@query("so13_set_equality_proof", """WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders), g AS (SELECT c_custkey AS k FROM customer) SELECT count(l.k) AS n_left, count(g.k) AS n_right, count(*) FILTER (g.k IS NULL) AS only_left, count(*) FILTER (l.k IS NULL) AS only_right,
count(*) FILTER (g.k IS NULL) = 0 AND count(*) FILTER (l.k IS NULL) = 0 AS equal FROM l FULL JOIN g ON l.k = g.k""")
def set_equality_proof(t):
    return matching.same_set(t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k")), "k")


@query("so15_so20_retry_set", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'excluded' ELSE 'retry' END AS plan FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30)""")
def retry_set(t):
    left = t.orders.join(t.lineitem.filter("l_quantity > 30"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return left.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "excluded").otherwise("retry").alias("plan"))


@query("so16_append_guard", """WITH planned AS (SELECT p_partkey AS k FROM part WHERE p_size > 40), old AS (SELECT p_partkey AS k FROM part WHERE p_size % 2 = 0) SELECT s_suppkey AS k, CASE WHEN s_suppkey NOT IN (SELECT k FROM planned) THEN 'unplanned' WHEN s_suppkey IN (SELECT k FROM old) THEN 'already there' ELSE 'ok' END AS verdict FROM supplier""")
def append_guard(t):
    planned = t.part.filter("p_size > 40").select(F.col("p_partkey").alias("k"), F.lit(True).alias("planned"))
    old = t.part.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("k"), F.lit(True).alias("old"))
    new = t.supplier.select(F.col("s_suppkey").alias("k")).join(planned, "k", "left").join(old, "k", "left")
    return new.select("k", F.when(F.col("planned").isNull(), "unplanned").when(F.col("old").isNotNull(), "already there").otherwise("ok").alias("verdict"))


@query("so19_validated_dedupe", """SELECT k, count(*) AS n, count(DISTINCT v) > 1 AS error FROM (SELECT l_partkey AS k, l_returnflag AS v FROM lineitem) GROUP BY k""")
def validated_dedupe(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"), (F.countDistinct("l_returnflag") > 1).alias("error"))


@query("so22_batch_completeness", """SELECT part, n, n = least(1000, total - part * 1000) AS complete FROM (SELECT doc_id // 1000 AS part, count(*) AS n FROM documents GROUP BY 1), (SELECT count(*) AS total FROM documents)""")
def batch_completeness(t):
    total = t.documents.count()
    parts = t.documents.groupBy(F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.count("*").alias("n"))
    return parts.select("part", "n", (F.col("n") == F.least(F.lit(1000), F.lit(total) - F.col("part") * 1000)).alias("complete"))


TERMS = ["licensed", "public", "rights", "public"]
BM25 = """w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1) AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w),
q AS (SELECT unnest(['licensed', 'public', 'rights']) AS term, unnest([1, 2, 1]) AS times), h AS (SELECT doc_id, len(w) AS l, term, times, len(list_filter(w, lambda x: x = term)) AS tf FROM w, q), d AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM h GROUP BY term),
b AS (SELECT doc_id, sum(times * ln((n - df + 5e-1) / (df + 5e-1) + 1e0) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * l / a))) AS score FROM h JOIN d USING (term), s GROUP BY doc_id HAVING sum(tf) > 0)"""


@query("tk01_tk02_bm25_top_k", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def bm25_top_k(t):
    scored = retrieval.bm25(t.documents, TERMS).select("doc_id", F.round("score", 6).alias("score"))
    return retrieval.top_k(scored, 20, F.desc("score"), F.asc("doc_id"))


VEC = """x AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1) AS w FROM documents),
u AS (SELECT doc_id, (('0x' || substr(md5(t), 1, 8))::BIGINT) % 256 AS d FROM (SELECT doc_id, unnest(w) AS t FROM x)), c AS (SELECT doc_id, d, count(*)::DOUBLE AS n FROM u GROUP BY doc_id, d), z AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM c GROUP BY doc_id)"""


def term_vectors(docs):
    """(doc_id, d, n): counts of hashed tokens in 256 dimensions."""
    from lumenweave.functions.text import tokens

    token = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("t"))
    place = F.pmod(F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long"), F.lit(256))
    return token.groupBy("doc_id", place.alias("d")).agg(F.count("*").cast("double").alias("n"))


@query("tk06_hashed_vectors", f"WITH {VEC} SELECT doc_id, count(*) AS n_dimensions, round(len, 6) AS len, round(max(n) / len, 6) AS top FROM c JOIN z USING (doc_id) GROUP BY doc_id, len")
def hashed_vectors(t):
    """Documents as L2-normalized vectors of hashed tokens, here by their shape."""
    length = F.sqrt(F.sum(F.col("n") * F.col("n")))
    return term_vectors(t.documents).groupBy("doc_id").agg(F.count("*").alias("n_dimensions"), F.round(length, 6).alias("len"), F.round(F.max("n") / length, 6).alias("top"))


@query("tk03_tk04_hybrid_rerank", f"""WITH {BM25}, {VEC}, qv AS (SELECT (('0x' || substr(md5(term), 1, 8))::BIGINT) % 256 AS d, times::DOUBLE AS n FROM q), ql AS (SELECT sqrt(sum(n * n)) AS len FROM qv),
k AS (SELECT doc_id, sum(c.n * qv.n) / any_value(z.len) / any_value(ql.len) AS cos FROM c JOIN qv USING (d) JOIN z USING (doc_id), ql GROUP BY doc_id), m AS (SELECT max(score) AS m FROM b)
SELECT doc_id, round(65e-2 * coalesce(score / m, 0) + 35e-2 * coalesce(cos, 0), 6) AS score FROM k LEFT JOIN b USING (doc_id), m ORDER BY score DESC, doc_id LIMIT 25""")
def hybrid_rerank(t):
    """All documents by words and by hashed vectors at once, in one scan of the texts."""
    places = retrieval.hashed_places(F.col("_w"))
    both = retrieval.scored(t.documents, TERMS, cos=retrieval.hashed_cosine(places, TERMS)).filter("cos > 0")
    most = both.agg(F.max("score")).first()[0] or 1.0
    ranked = both.select("doc_id", F.round(retrieval.hybrid(F.col("score"), F.col("cos"), F.lit(most)), 6).alias("score"))
    return retrieval.top_k(ranked, 25, F.desc("score"), F.asc("doc_id"))


@query("tk07_centroid_cosine", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS c FROM e GROUP BY label, i)
SELECT vec_id, round(greatest(0, least(1, sum(x * c) / sqrt(sum(x * x)) / sqrt(sum(c * c)))), 5) AS cosine FROM e JOIN m USING (label, i) GROUP BY vec_id""")
def centroid_cosine(t):
    e = t.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    m = e.groupBy("label", "i").agg(F.avg("x").alias("c"))
    dot = F.sum(F.col("x") * F.col("c")) / F.sqrt(F.sum(F.col("x") * F.col("x"))) / F.sqrt(F.sum(F.col("c") * F.col("c")))
    return e.join(m, ["label", "i"]).groupBy("vec_id").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot)), 5).alias("cosine"))


@query("tk08_tk09_first_hit", """SELECT source, coalesce(min(doc_id) FILTER (lower(text) LIKE '%rights reserved%'), min(doc_id)) AS doc_id FROM documents GROUP BY source""")
def first_hit(t):
    hit = F.when(F.lower("text").contains("rights reserved"), F.col("doc_id"))
    return t.documents.groupBy("source").agg(F.coalesce(F.min(hit), F.min("doc_id")).alias("doc_id"))


@query("tk10_largest_candidates", """SELECT source, doc_id, n_chars, rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3""")
def largest_candidates(t):
    return retrieval.top_k_by(t.documents.select("source", "doc_id", "n_chars"), "source", 3, F.desc("n_chars"), F.asc("doc_id")).select("source", "doc_id", "n_chars", "rank")


@query("tk11_nearest_preceding", """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events""")
def nearest_preceding(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("before"))
