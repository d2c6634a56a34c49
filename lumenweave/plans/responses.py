"""Queries over extractors' answers, made of the driver's rows in the shapes that answers come in."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import responses
from lumenweave.operators import variants

from .labels import pick
from .registry import query


@query("st44_table_categories", """SELECT o_orderkey, ['outcome', 'safety', 'baseline', 'unknown', 'flow', 'unknown'][(o_orderkey % 6 + 1)::INT] AS category,
CASE WHEN o_orderkey % 6 <> 5 AND o_orderkey % 300 <= 100 THEN (o_orderkey % 300) / 100.0::DOUBLE END AS confidence, CASE WHEN o_orderkey % 6 IN (0, 2) THEN 'as ' || o_orderstatus ELSE 'NR' END AS rationale FROM orders""")
def table_categories(t):
    """Flat and nested answers, other names of categories, confidences above one, and texts that are no answer."""
    name = pick("o_orderkey", '"category": "Clinical-Outcomes"', '"table_type": "adverse event"', '"table_category": " Baseline "', '"category": "recipe"', '"category": "", "table_type": "consort flow"', "")
    reason = pick("o_orderkey", '"reason"', '"note"', '"explanation"', '"note"', '"note"', '"note"')
    flat = F.concat(F.lit("{"), name, F.lit(', "confidence": '), ((F.col("o_orderkey") % 300) / 100).cast("string"), F.lit(", "), reason, F.lit(': "as '), F.col("o_orderstatus"), F.lit(' "}'))
    said = F.when(F.col("o_orderkey") % 6 == 5, "no answer").when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit('{"classification": '), flat, F.lit("}"))).otherwise(flat)
    return t.orders.select("o_orderkey", responses.table_category(said).alias("r")).select("o_orderkey", "r.*")


@query("st42_arm_items", """SELECT s_suppkey, i AS item, CASE WHEN s_suppkey % 4 IN (0, 2) AND i = 0 THEN 'a' || s_suppkey ELSE 'NR' END AS arm_id,
CASE WHEN s_suppkey % 4 = 1 THEN 'only ' || s_suppkey WHEN i = 1 THEN 'second' ELSE s_name END AS arm_label, CASE WHEN i = 1 OR s_suppkey % 4 = 1 THEN 'NR' WHEN s_suppkey % 4 = 0 THEN 'intervention' ELSE 'other' END AS role,
CASE WHEN s_suppkey % 4 IN (0, 2) AND i = 0 AND s_nationkey > 3 THEN s_nationkey - 4 END::BIGINT AS n, CASE WHEN s_suppkey % 4 IN (0, 2) AND i = 0 THEN s_acctbal END AS estimate,
CASE WHEN s_suppkey % 4 IN (0, 2) AND i = 0 THEN s_nationkey / 2.0::DOUBLE END AS lower, CASE WHEN s_suppkey % 4 IN (0, 2) AND i = 0 THEN s_nationkey + 1.0::DOUBLE END AS upper
FROM supplier, (VALUES (0), (1)) v(i) WHERE s_suppkey % 4 <> 3 AND (i = 0 OR s_suppkey % 4 = 0)""")
def arm_items(t):
    """A list of an object and a label, a label alone, an object alone, and none; intervals as lists and as words, counts below zero."""
    text = lambda c: F.col(c).cast("string")
    half = (F.col("s_nationkey") / 2).cast("string")
    list_ = F.concat(F.lit('{"id": "a'), text("s_suppkey"), F.lit('", "name": "'), F.col("s_name"), F.lit('", "role": "Treatment", "sample_size": "'), (F.col("s_nationkey") - 4).cast("string"), F.lit('", "change": '), text("s_acctbal"), F.lit(', "confidence_interval": ['), half, F.lit(", "), (F.col("s_nationkey") + 1).cast("string"), F.lit("]}"))
    object_ = F.concat(F.lit('{"arm_id": "a'), text("s_suppkey"), F.lit('", "label": "'), F.col("s_name"), F.lit('", "arm_role": "judge", "n": '), (F.col("s_nationkey") - 4).cast("string"), F.lit(', "value": '), text("s_acctbal"), F.lit(', "ci_lower": '), half, F.lit(', "ci_upper": '), (F.col("s_nationkey") + 1).cast("string"), F.lit("}"))
    at = F.col("s_suppkey") % 4
    raw = F.when(at == 0, F.concat(F.lit("["), list_, F.lit(', " second "]'))).when(at == 1, F.concat(F.lit(" only "), text("s_suppkey"))).when(at == 2, object_).otherwise("NR")
    items = t.supplier.select("s_suppkey", F.posexplode(responses.arms(raw)).alias("item", "arm"))
    return items.select("s_suppkey", "item", *[F.col(f"arm.{f}").alias(f) for f in ("arm_id", "arm_label", "role", "n", "estimate", "lower", "upper")])


@query("aj11_folded_support", """SELECT c_custkey, '{"rows":[{"field_id":' || c_custkey || ',"quote":"Q","source":"text"},[{"field_id":1,"quote":"A","support_type":"direct"},{"field_id":2,"source":"TABLE"}]],"source":"' || c_mktsegment || '"}' AS folded FROM customer""")
def folded_support(t):
    fold = F.pandas_udf(responses.lower_support, "string")
    raw = F.concat(F.lit('{"rows": [{"field_id": '), F.col("c_custkey").cast("string"), F.lit(', "quote": "Q", "source": "TEXT"}, [{"field_id": 1, "quote": "A", "support_type": "Direct"}, {"field_id": 2, "source": "TABLE"}]], "source": "'), F.col("c_mktsegment"), F.lit('"}'))
    return t.customer.select("c_custkey", fold(raw).alias("folded"))


@query("aj10_payload_records", """SELECT c_custkey, i AS record, c_custkey * 10 + i AS source_index, CASE WHEN i = 0 THEN c_name ELSE 'NR' END AS normalized_outcome_name, CASE WHEN i = 0 THEN c_mktsegment ELSE 'NR' END AS instrument,
CASE WHEN i = 0 THEN ['conflict', 'none', 'unresolved', 'not_checked'][(c_custkey % 4 + 1)::INT] ELSE 'unresolved' END AS annotation_status, CASE WHEN i = 0 THEN c_nationkey || ',x' ELSE c_nationkey::VARCHAR END AS gold_row_ids
FROM customer, (VALUES (0), (1)) v(i) WHERE c_custkey % 5 <> 4""")
def payload_records(t):
    """Two records a customer under either name and either spelling of fields, between them one without an index; every fifth answer has no list."""
    k, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    status = pick("c_custkey", "gold_conflict", "no_conflict", "guessed", "not_checked")
    first = F.concat(F.lit('{"index": "'), k, F.lit('0", "outcome_name": "'), F.col("c_name"), F.lit('", "measurementInstrument": "", "instrument": "'), F.col("c_mktsegment"), F.lit('", "conflictStatus": "'), status, F.lit('", "gold_ids": ['), nation, F.lit(', "", null, "x"]}'))
    second = F.concat(F.lit('{"sourceIndex": '), (F.col("c_custkey") * 10 + 1).cast("string"), F.lit(', "normalizedOutcomeName": "", "goldRowIds": '), nation, F.lit("}"))
    list_ = F.concat(F.lit("["), first, F.lit(', "text", {"index": "none"}, '), second, F.lit("]"))
    raw = F.when(F.col("c_custkey") % 5 == 4, '{"records": {"index": 1}}').otherwise(F.concat(pick("c_custkey", '{"records": ', '{"outcomes": '), list_, F.lit("}")))
    # Spread by a number, which is not put together again: a small file is one task, and reading its answers is slow.
    customers = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    customers = customers.repartition(int(customers.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    rows = customers.select("c_custkey", F.posexplode(responses.records(raw)).alias("record", "r"))
    return rows.select("c_custkey", "record", "r.source_index", "r.normalized_outcome_name", F.col("r.normalized_measurement_instrument").alias("instrument"), "r.annotation_status", F.array_join("r.gold_row_ids", ",").alias("gold_row_ids"))


NESTED = """j AS (SELECT l_orderkey AS id, json_object('order', json_object('status', any_value(o_orderstatus), 'clerk', NULL, 'codes', [min(l_linenumber), max(l_linenumber)], 'lines',
list(json_object('part', l_partkey, 'flags', [l_returnflag, l_linestatus], 'evidence', [json_object('q', l_suppkey), json_object('q', 1)], 'deep', json_object('a', [json_object('b', [[l_suppkey], [1, 2]])])) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag)), 'empty', json_object(), 'none', []) AS j
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)"""


@query("pf25_recursive_flatten", f"""WITH {NESTED}, t AS (SELECT j.id, replace(x.fullkey, '"', '') AS k, x.type, x.value, x.atom, x.key FROM j, json_tree(j.j) x),
leaf AS (SELECT id, k, CASE WHEN key = 'evidence' THEN 'evidence' WHEN type = 'ARRAY' THEN 'list' ELSE 'value' END AS kind, CASE WHEN key = 'evidence' THEN json_array_length(value)::VARCHAR WHEN type = 'ARRAY' THEN value::VARCHAR WHEN type = 'NULL' THEN NULL ELSE value ->> '$' END AS value
  FROM t WHERE k <> '$' AND type <> 'OBJECT' AND NOT contains(k, '.evidence[') AND (type <> 'ARRAY' OR key = 'evidence' OR NOT contains(value::VARCHAR, '{{') AND NOT contains(substr(value::VARCHAR, 2), '['))
  AND (type = 'ARRAY' OR NOT regexp_matches(k, '\\]$')))
SELECT id, substr(k, 3) AS path, kind, value FROM leaf""")
def recursive_flatten(t):
    """Orders with their lines as nested JSON, as rows again: objects in lists in objects, lists of lists, evidence counted."""
    line = F.struct(
        F.col("l_partkey").alias("part"), F.array("l_returnflag", "l_linestatus").alias("flags"), F.array(F.struct(F.col("l_suppkey").alias("q")), F.struct(F.lit(1).cast("long").alias("q"))).alias("evidence"),
        F.struct(F.array(F.struct(F.array(F.array("l_suppkey"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("b"))).alias("a")).alias("deep"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", line.alias("line"))))
    grouped = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("l_orderkey").alias("id")).agg(
        F.first("o_orderstatus").alias("status"), F.array(F.min("l_linenumber"), F.max("l_linenumber")).alias("codes"), F.transform(ordered, lambda x: x["line"]).alias("lines")
    )
    order = F.struct("status", F.lit(None).cast("string").alias("clerk"), "codes", "lines").alias("order")
    nested = F.to_json(F.struct(order, F.lit(None).cast("string").alias("empty"), F.array().cast("array<string>").alias("none")), {"ignoreNullFields": "false"})
    texts = grouped.select("id", F.regexp_replace(nested, r'"empty":null', r'"empty":{}').alias("j"))
    return variants.flatten(texts, ["id"], "j")


@query("aj09_alias_pick", """WITH j AS (SELECT event_id, json(CASE event_id % 4 WHEN 0 THEN '{"label": "L' || user_id || '", "name": null}' WHEN 1 THEN '{"title": "T", "label": ' || user_id || '}' WHEN 2 THEN props ELSE '{"name": {"x": [' || user_id || ', null]}}' END) AS j FROM events)
SELECT event_id, CASE WHEN list_contains(json_keys(j), 'name') THEN j ->> 'name' WHEN list_contains(json_keys(j), 'label') THEN j ->> 'label' WHEN list_contains(json_keys(j), 'k') THEN j ->> 'k' END AS value FROM j""")
def alias_pick(t):
    """The first key present of name, label and k, even where its value is null."""
    user = F.col("user_id").cast("string")
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit('{"label": "L'), user, F.lit('", "name": null}'))).when(kind == 1, F.concat(F.lit('{"title": "T", "label": '), user, F.lit("}")))
        .when(kind == 2, F.col("props")).otherwise(F.concat(F.lit('{"name": {"x": ['), user, F.lit(", null]}}")))
    )
    return t.events.select("event_id", variants.first_present(F.parse_json(text), "name", "label", "k").alias("value"))
