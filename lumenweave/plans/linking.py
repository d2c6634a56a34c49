"""Queries over links under constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import linking

from .registry import query

#: Documents of even ids as predictions, those of odd ids as the reference; all rows are dealt.
SIDES = """d AS (SELECT doc_id AS id, md5(text) AS same, lang, lower(substr(text, 1, 12)) AS concept, CASE WHEN doc_id % 5 <> 0 THEN source END AS instrument, CASE WHEN n_chars % 3 <> 0 THEN n_chars // 40 END AS unit, coalesce(n_chars, 0) % 17 = 0 AS blocked, source, n_chars FROM documents),
p AS (SELECT * FROM d WHERE id % 2 = 0), g AS (SELECT * FROM d WHERE id % 2 <> 0),
k AS (SELECT min(g.id) AS gold, min(p.id) AS pred FROM g JOIN p USING (same) GROUP BY same UNION SELECT g.id, p.id FROM g JOIN p ON p.id = g.id + 1 AND g.lang = p.lang AND g.n_chars % 5 = 0)"""


def _sides(t):
    d = t.documents.select(
        F.col("doc_id").alias("id"), F.md5("text").alias("same"), "lang", F.lower(F.substring("text", 1, 12)).alias("concept"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("instrument"),
        F.when(F.col("n_chars") % 3 != 0, F.floor(F.col("n_chars") / 40)).alias("unit"), (F.coalesce("n_chars", F.lit(0)) % 17 == 0).alias("blocked"), "source", "n_chars",
    )
    return d.filter("id % 2 = 0"), d.filter("id % 2 <> 0")


@query("jn09_ag11_constrained_links", f"""WITH RECURSIVE {SIDES},
h AS (SELECT a.id AS u, b.id AS v FROM (SELECT same, min(id) AS id FROM p GROUP BY same) a JOIN p b USING (same) UNION SELECT a.id, b.id FROM (SELECT source, n_chars, lang, min(id) AS id FROM p GROUP BY ALL) a JOIN p b USING (source, n_chars, lang)),
b AS (SELECT u, v FROM h UNION SELECT v, u FROM h), w AS (SELECT u AS id, u AS r FROM b UNION SELECT b.v, w.r FROM w JOIN b ON b.u = w.id), c AS (SELECT id, min(r) AS grp FROM w GROUP BY id),
m AS (SELECT p.*, coalesce(grp, p.id) AS grp FROM p LEFT JOIN c USING (id)),
t AS (SELECT grp, count(DISTINCT gold) AS n, min(gold) AS gold FROM k JOIN m ON m.id = k.pred GROUP BY grp), l AS (SELECT gold AS id, min(pred) AS other FROM k GROUP BY gold),
e AS (SELECT g.id AS gold, m.id AS pred FROM g JOIN m ON m.id = m.grp AND g.lang = m.lang AND g.concept = m.concept AND coalesce(g.instrument = m.instrument, true) AND coalesce(g.unit = m.unit, true)
  WHERE NOT g.blocked AND NOT m.blocked AND g.id NOT IN (SELECT id FROM l) AND m.id NOT IN (SELECT grp FROM t)),
f AS (SELECT *, count(*) OVER (PARTITION BY gold) AS dg, count(*) OVER (PARTITION BY pred) AS dp FROM e),
fg AS (SELECT gold AS id, any_value(dg) AS n, min(pred) FILTER (dg = 1 AND dp = 1) AS other FROM f GROUP BY gold), fp AS (SELECT pred AS id, any_value(dp) AS n, min(gold) FILTER (dg = 1 AND dp = 1) AS other FROM f GROUP BY pred)
SELECT 'reference' AS side, g.id, CASE WHEN l.other IS NOT NULL OR fg.other IS NOT NULL THEN 'LINKED' WHEN fg.n > 1 THEN 'SPLIT' WHEN fg.n = 1 THEN 'MERGED' ELSE 'MISSING' END AS status, coalesce(l.other, fg.other) AS other FROM g LEFT JOIN l USING (id) LEFT JOIN fg USING (id)
UNION ALL SELECT 'group', q.grp, CASE WHEN t.n > 1 THEN 'BLOCKED' WHEN t.n = 1 OR fp.other IS NOT NULL THEN 'LINKED' WHEN fp.n > 0 THEN 'SPLIT' ELSE 'EXTRA' END, CASE WHEN t.n = 1 THEN t.gold WHEN t.n IS NULL THEN fp.other END
FROM (SELECT DISTINCT grp FROM m) q LEFT JOIN t USING (grp) LEFT JOIN fp ON fp.id = q.grp""")
def constrained_links(t):
    """Documents' groups, by hints of being the same, linked with documents of the other side; earlier links are locks."""
    p, g = _sides(t)
    stars = [p.groupBy(*k).agg(F.min("id").alias("u")).join(p.select(*k, F.col("id").alias("v")), k).select("u", "v") for k in (["same"], ["source", "n_chars", "lang"])]
    locks = g.groupBy("same").agg(F.min("id").alias("gold")).join(p.groupBy("same").agg(F.min("id").alias("pred")), "same").select("gold", "pred")
    near = g.select((F.col("id") + 1).alias("pred"), F.col("id").alias("gold"), "lang", "n_chars").filter("n_chars % 5 = 0").join(p.select(F.col("id").alias("pred"), F.col("lang").alias("p_lang")), "pred").filter("lang = p_lang")
    locks = locks.union(near.select("gold", "pred")).distinct()
    grouped = linking.alias_groups(p, stars[0].union(stars[1]))
    return linking.link_groups(grouped, g, locks, ["lang", "concept"], ["instrument", "unit"])


RESULTS = """r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber % 2 = 1 AS is_gold, 'line' AS kind, CASE WHEN l_linenumber % 2 = 1 OR o_orderstatus <> 'P' THEN l_orderkey END AS parent, CASE WHEN l_linenumber % 2 = 1 OR l_partkey % 9 <> 0 THEN l_suppkey % 2 END AS outcome, l_discount > 5e-2 AS derived,
CASE WHEN l_quantity > 8 THEN month(l_shipdate) % 2 END AS timepoint, CASE WHEN l_partkey % 4 <> 0 THEN l_linestatus END AS analysis_set, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS statistic_kind, CASE WHEN l_partkey % 11 = 0 THEN 'SOURCE_CONFLICT' END AS blocker
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_discount) AS l_discount, min(l_quantity) AS l_quantity, min(l_shipdate) AS l_shipdate, min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber)
JOIN orders ON o_orderkey = l_orderkey), g AS (SELECT * FROM r WHERE is_gold), p AS (SELECT * FROM r WHERE NOT is_gold)"""
SEEN = {"parent": "a.parent = b.parent", "outcome": "a.outcome = b.outcome", "timepoint": "coalesce(a.timepoint = b.timepoint, true)", "analysis_set": "coalesce(a.analysis_set = b.analysis_set, true)",
        "statistic_kind": "coalesce(a.statistic_kind = b.statistic_kind, true)", "derived": "a.derived = b.derived"}


def _side_sql(own: str, other: str, side: str, which: int) -> str:
    """A side's statuses and reasons by pairs of one order, which are few."""
    narrowing, tests = "", []
    for d, *reasons in linking.NARROWING:
        tests.append(SEEN[d])
        narrowing += f" WHEN coalesce(bool_or({' AND '.join(tests)}), false) = false THEN '{reasons[which]}'"
    viable = " AND ".join(SEEN.values())
    unmapped = " WHEN a.parent IS NULL THEN 'MISSING_PARENT' WHEN a.outcome IS NULL THEN 'OUTCOME_AMBIGUOUS'" if which else ""
    return f"""SELECT '{side}' AS side, id, CASE WHEN ok THEN 'MATCHED' WHEN n > 0 THEN 'AMBIGUOUS' ELSE '{('MISSING', 'EXTRA')[which]}' END AS status, CASE WHEN ok THEN partner END AS other,
CASE WHEN ok THEN 'UNIQUE_SAFE_RESULT_LINK' WHEN n > 1 OR n = 1 AND safe THEN 'MULTIPLE_SAFE_CANDIDATES' WHEN n = 1 THEN coalesce(blocker, CASE WHEN NOT time THEN 'TIMEPOINT_AMBIGUOUS' WHEN NOT stat THEN 'STATISTIC_KIND_AMBIGUOUS' ELSE 'ANALYSIS_SET_AMBIGUOUS' END) ELSE none END AS reason
FROM (SELECT x.*, coalesce(n = 1 AND safe AND back = 1, false) AS ok FROM (
  SELECT a.id, any_value(a.blocker) AS blocker, count(*) FILTER ({viable}) AS n, min(b.id) FILTER ({viable}) AS partner,
    bool_and(a.timepoint IS NOT NULL AND b.timepoint IS NOT NULL) FILTER ({viable}) AS time, bool_and(a.statistic_kind IS NOT NULL AND b.statistic_kind IS NOT NULL) FILTER ({viable}) AS stat,
    bool_and(a.timepoint IS NOT NULL AND b.timepoint IS NOT NULL AND a.statistic_kind IS NOT NULL AND b.statistic_kind IS NOT NULL AND a.blocker IS NULL AND b.blocker IS NULL) FILTER ({viable}) AS safe,
    any_value(CASE {unmapped} ELSE NULL END) AS unmapped, coalesce(any_value(CASE {unmapped} ELSE NULL END), CASE {narrowing} END) AS none
  FROM {own} a LEFT JOIN {other} b ON a.parent = b.parent GROUP BY a.id) x
  LEFT JOIN (SELECT b.id AS partner, count(*) AS back FROM {other} b JOIN {own} a ON {viable} GROUP BY b.id) y USING (partner))""".replace("CASE  ELSE NULL END", "NULL")


@query("jn07_seven_dimensions", f"WITH {RESULTS} {_side_sql('g', 'p', 'reference', 0)} UNION ALL {_side_sql('p', 'g', 'prediction', 1)}")
def seven_dimensions(t):
    """Line items of odd numbers as the reference's results, those of even numbers as predicted ones: status, partner and reason."""
    odd = F.col("l_linenumber") % 2 == 1
    columns = ["l_partkey", "l_suppkey", "l_discount", "l_quantity", "l_shipdate", "l_linestatus", "l_returnflag"]
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in columns])
    r = lines.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), odd.alias("is_gold"), F.lit("line").alias("kind"), F.when(odd | (F.col("o_orderstatus") != "P"), F.col("l_orderkey")).alias("parent"),
        F.when(odd | (F.col("l_partkey") % 9 != 0), F.col("l_suppkey") % 2).alias("outcome"), (F.col("l_discount") > 0.05).alias("derived"), F.when(F.col("l_quantity") > 8, F.month("l_shipdate") % 2).alias("timepoint"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_linestatus")).alias("analysis_set"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("statistic_kind"),
        F.when(F.col("l_partkey") % 11 == 0, "SOURCE_CONFLICT").alias("blocker"),
    )
    return linking.link_results(r.filter("is_gold"), r.filter("NOT is_gold"))
