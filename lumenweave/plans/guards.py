"""Queries over what steps may change, and what cells say."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.operators import guards

from .registry import query

STEP = """a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice + 1 END AS price, o_orderpriority FROM orders WHERE o_orderkey % 97 > 0),
b AS (SELECT o_orderkey AS k, o_orderstatus, o_totalprice AS price, o_orderpriority FROM orders WHERE o_orderkey % 101 > 0)"""


def _step(t):
    """Orders before and after a step that may change prices only, and changes some states, drops some orders and adds others."""
    orders = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus", F.col("o_totalprice").alias("price"), "o_orderpriority")
    after = orders.filter("k % 97 > 0").select("k", F.when(F.col("k") % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("k") % 5 != 0, F.col("price") + 1).alias("price"), "o_orderpriority")
    return orders.filter("k % 101 > 0"), after


@query("so24_so25_out_of_scope", f"""WITH {STEP}, j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS gone, b.k IS NULL AS fresh, b.o_orderstatus AS s1, a.o_orderstatus AS s2, b.o_orderpriority AS p1, a.o_orderpriority AS p2 FROM b FULL JOIN a ON a.k = b.k)
SELECT k, field, CASE WHEN gone THEN 'REMOVED' WHEN fresh THEN 'ADDED' ELSE 'CHANGED' END AS change, CASE field WHEN 'o_orderstatus' THEN s1 WHEN 'o_orderpriority' THEN p1 END AS before, CASE field WHEN 'o_orderstatus' THEN s2 WHEN 'o_orderpriority' THEN p2 END AS after
FROM j, (SELECT unnest(['o_orderstatus', 'o_orderpriority', 'price']) AS field) WHERE gone OR fresh OR (field = 'o_orderstatus' AND s1 IS DISTINCT FROM s2) OR (field = 'o_orderpriority' AND p1 IS DISTINCT FROM p2)""")
def out_of_scope(t):
    """Fields that a step changed though only prices were its business; prices' own values are left out here."""
    found = guards.out_of_scope(*_step(t), ["k"], ["price"])
    blank = lambda c: F.when(F.col("field") != "price", F.col(c)).alias(c)
    return found.select("k", "field", "change", blank("before"), blank("after"))


@query("so17_invariants", f"""WITH {STEP}, m AS (SELECT 'n' AS measure, (SELECT count(*) FROM b)::VARCHAR AS before, (SELECT count(*) FROM a)::VARCHAR AS after UNION ALL SELECT 'priorities', (SELECT count(DISTINCT o_orderpriority) FROM b)::VARCHAR, (SELECT count(DISTINCT o_orderpriority) FROM a)::VARCHAR
UNION ALL SELECT 'priced', (SELECT count(price) FROM b)::VARCHAR, (SELECT count(price) FROM a)::VARCHAR UNION ALL SELECT 'odd keys', (SELECT sum(k % 2) FROM b)::BIGINT::VARCHAR, (SELECT sum(k % 2) FROM a)::BIGINT::VARCHAR) SELECT *, before IS NOT DISTINCT FROM after AS same FROM m""")
def invariants(t):
    """Counts that a step over orders must leave as they are, and which it did not."""
    measures = {"n": F.count("*"), "priorities": F.countDistinct("o_orderpriority"), "priced": F.count("price"), "odd keys": F.sum(F.col("k") % 2)}
    return guards.invariants(*_step(t), measures)


@query("pl15_surface_repair", r"""WITH s AS (SELECT p_partkey AS k, p_type AS v0, regexp_replace(p_type, '\s+', ' ', 'g') AS v1 FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN 'NEW  ' || p_type WHEN 2 THEN p_type || ' (NR)' END AS p_type FROM part)),
r AS (SELECT k, v0, v1, regexp_replace(v1, ' \(NR\)$', '') AS v2 FROM s), al AS (SELECT p_type AS alias, lower(p_type) AS canonical FROM part WHERE p_size % 3 > 0 UNION SELECT p_type, p_brand FROM part WHERE p_type IN ('SMALL', 'LARGE')),
o AS (SELECT alias, count(DISTINCT canonical) AS n, min(canonical) AS c FROM al GROUP BY alias)
SELECT k, v0 AS before, CASE WHEN n = 1 THEN c ELSE v2 END AS after, CASE WHEN n > 1 THEN 'AMBIGUOUS' WHEN n = 1 AND c IS DISTINCT FROM v0 THEN 'BOUND' WHEN v0 IS DISTINCT FROM v2 THEN 'NORMALIZED' ELSE 'UNCHANGED' END AS action,
array_to_string(list_filter([CASE WHEN v0 IS DISTINCT FROM v1 THEN 'spaces' END, CASE WHEN v1 IS DISTINCT FROM v2 THEN 'suffix' END], lambda x: x IS NOT NULL), ',') AS rules FROM r LEFT JOIN o ON alias = v2""")
def surface_repair(t):
    """Parts' types written with spaces and suffixes, repaired and bound to a canonical form where one owns them: the audit."""
    kind, key = F.col("p_type"), F.col("p_partkey") % 4
    rows = t.part.select(F.col("p_partkey").alias("k"), F.when(key == 0, kind).when(key == 1, F.concat(F.lit("NEW  "), kind)).when(key == 2, F.concat(kind, F.lit(" (NR)"))).alias("v"))
    aliases = t.part.filter("p_size % 3 > 0").select(kind.alias("alias"), F.lower(kind).alias("canonical")).union(t.part.filter("p_type IN ('SMALL', 'LARGE')").select(kind, "p_brand"))
    return guards.surface_repair(rows, "k", "v", [("spaces", r"\s+", " "), ("suffix", r" \(NR\)$", "")], aliases)[1]


@query("nm05_nm14_cells", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 3 THEN NULL ELSE l_discount END::DOUBLE AS p, CASE l_linenumber % 4 WHEN 0 THEN '<' WHEN 1 THEN '=' WHEN 2 THEN '≤' ELSE 'NR' END AS comparator,
CASE WHEN l_linenumber % 3 < 2 THEN -l_quantity END::DOUBLE AS lower, CASE WHEN l_linenumber % 3 < 2 THEN l_quantity END::DOUBLE AS upper FROM lineitem""")
def cells(t):
    """Discounts as P values and quantities as intervals, in the forms that cells have."""
    n, p, q = F.col("l_linenumber"), F.col("l_discount").cast("string"), F.col("l_quantity").cast("string")
    p_text = F.when(n % 4 == 0, F.concat(F.lit("P < "), p)).when(n % 4 == 1, p).when(n % 4 == 2, F.concat(F.lit(" p≤"), p, F.lit(" "))).otherwise(F.concat(F.lit("p = "), p, F.lit("*")))
    ci_text = F.when(n % 3 == 0, F.concat(F.lit("95% CI: -"), q, F.lit(" to "), q)).when(n % 3 == 1, F.concat(F.lit("(-"), q, F.lit("TO"), q, F.lit(")"))).otherwise(F.concat(F.lit("-"), q, F.lit(", "), q))
    told = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", guards.p_cell(p_text).alias("p"), guards.interval_to(ci_text).alias("ci"))
    return told.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("p.value").alias("p"), F.col("p.comparator").alias("comparator"), F.col("ci.lower").alias("lower"), F.col("ci.upper").alias("upper"))
