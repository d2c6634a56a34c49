"""Queries over identity by several dimensions, evidence, vocabularies and cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenweave.functions import cells
from lumenweave.operators import identity

from .registry import query


@query("jn06_three_valued_match", """SELECT p_partkey, CASE WHEN (p_size % 5 = 0) IS FALSE AND p_size % 3 <> 0 THEN false WHEN p_size > 25 IS FALSE THEN false WHEN p_size % 3 = 0 THEN NULL ELSE true END AS matched FROM part""")
def three_valued_match(t):
    first = F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 5 == 0)
    return t.part.select("p_partkey", identity.three_valued(first, F.col("p_size") > 25).alias("matched"))


PAIRS = """b AS (SELECT c_custkey, s_suppkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS cn, s_nationkey AS sn, c_acctbal > 0 AS ca, s_acctbal > 0 AS sa FROM customer JOIN supplier ON c_custkey // 10 = s_suppkey)"""


def pairs(t):
    c = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("cn"), (F.col("c_acctbal") > 0).alias("ca"), F.expr("c_custkey DIV 10").alias("k"))
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("sn"), (F.col("s_acctbal") > 0).alias("sa"), F.col("s_suppkey").alias("k"))
    return c.join(s, "k").drop("k")


@query("jn08_dimension_compatibility", f"""WITH {PAIRS} SELECT c_custkey, s_suppkey, (cn IS NULL OR cn = sn) AND ca = sa AS viable, coalesce(cn = sn, false) AND ca = sa AS safe FROM b""")
def dimension_compatibility(t):
    state = identity.compatibility(identity.dimension(F.col("cn"), F.col("sn")), identity.dimension(F.col("ca"), F.col("sa")))
    return pairs(t).select("c_custkey", "s_suppkey", state["viable"].alias("viable"), state["safe"].alias("safe"))


@query("jn05_residual_match", f"""WITH {PAIRS}, v AS (SELECT * FROM b WHERE (cn IS NULL OR cn = sn) AND ca = sa), l AS (SELECT *, count(*) OVER (PARTITION BY c_custkey) AS dc, count(*) OVER (PARTITION BY s_suppkey) AS ds FROM v)
SELECT c_custkey, s_suppkey, CASE WHEN dc = 1 AND ds = 1 AND cn = sn THEN 'locked' WHEN dc = 1 AND ds = 1 THEN 'uncertain' ELSE 'blocked' END AS status FROM l""")
def residual_match(t):
    """Unique and certain pairs are locked; unique but uncertain ones wait for a judge; competitors block each other."""
    state = identity.compatibility(identity.dimension(F.col("cn"), F.col("sn")), identity.dimension(F.col("ca"), F.col("sa")))
    viable = pairs(t).withColumn("s", state).filter("s.viable")
    degree = lambda c: F.count("*").over(Window.partitionBy(c))
    unique = (F.col("dc") == 1) & (F.col("ds") == 1)
    told = viable.withColumn("dc", degree("c_custkey")).withColumn("ds", degree("s_suppkey"))
    return told.select("c_custkey", "s_suppkey", F.when(unique & F.col("s.safe"), "locked").when(unique, "uncertain").otherwise("blocked").alias("status"))


@query("jn14_jn15_reciprocal_evidence", """WITH f AS (SELECT o_orderkey, l_linenumber AS e FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 5), b AS (SELECT DISTINCT l_orderkey, l_linenumber AS e FROM lineitem WHERE l_discount > 1e-2)
SELECT o_orderkey, bool_and(f.e IS NOT NULL AND b.e IS NOT NULL) AS grounded FROM f LEFT JOIN b ON b.l_orderkey = f.o_orderkey AND b.e = f.e GROUP BY o_orderkey""")
def reciprocal_evidence(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("e"), "l_quantity", "l_discount")
    fields = t.orders.select("o_orderkey").join(lines.filter("l_quantity > 5").groupBy("o_orderkey").agg(F.collect_set("e").alias("e")), "o_orderkey", "left")
    return identity.reciprocal(fields, lines.filter(F.col("l_discount") > 0.01), "o_orderkey", "e")


@query("jn19_multi_label_bind", """WITH a AS (SELECT DISTINCT p_type AS label, CASE WHEN p_type LIKE '%O%' THEN 'x' ELSE 'y' END AS owner FROM part UNION SELECT min(p_type), 'z' FROM part), o AS (SELECT label, min(owner) AS owner, count(DISTINCT owner) AS n FROM a GROUP BY label)
SELECT p_brand, CASE WHEN count(*) FILTER (coalesce(o.n <> 1, true)) = 0 AND count(DISTINCT o.owner) = 1 THEN min(o.owner) END AS owner FROM (SELECT DISTINCT p_brand || p_size AS p_brand, p_type AS label FROM part) l LEFT JOIN o USING (label) GROUP BY p_brand""")
def multi_label_bind(t):
    owned = t.part.select(F.col("p_type").alias("label"), F.when(F.col("p_type").contains("O"), "x").otherwise("y").alias("owner")).distinct()
    aliases = owned.union(t.part.agg(F.min("p_type").alias("label")).withColumn("owner", F.lit("z")))
    labels = t.part.select(F.concat("p_brand", "p_size").alias("p_brand"), F.col("p_type").alias("label")).distinct()
    return identity.bind_all(labels, aliases, "p_brand", "label", "owner")


@query("jn23_narrowed_rows", """SELECT o_orderkey, CASE WHEN count(*) FILTER (l_quantity > 40 AND l_returnflag <> 'R') = 0 THEN count(*) FILTER (l_quantity > 40) ELSE 0 END AS n_rows FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def narrowed_rows(t):
    """Rows that a field's evidence names, none if any lies outside the result's rows."""
    both = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    named = F.col("l_quantity") > 40
    return both.groupBy("o_orderkey").agg(F.when(F.count_if(named & (F.col("l_returnflag") != "R")) == 0, F.count_if(named)).otherwise(0).alias("n_rows"))


@query("jn27_provenance_union", """SELECT o_custkey, array_to_string(list_sort(list(DISTINCT k)), ',') AS sources FROM (SELECT o_custkey, 'o' || o_orderkey % 7 AS k FROM orders UNION ALL SELECT o_custkey, 'l' || l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY o_custkey""")
def provenance_union(t):
    own = t.orders.select("o_custkey", F.concat(F.lit("o"), F.col("o_orderkey") % 7).alias("k"))
    seen = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.concat(F.lit("l"), "l_linenumber").alias("k"))
    return own.union(seen).groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("sources"))


@query("jn30_jn31_present_equality", """SELECT c_custkey, s_suppkey, n_required, n_matched, n_matched = n_required AS accepted FROM (SELECT c_custkey, s_suppkey, count(cn) OVER (PARTITION BY c_custkey, s_suppkey) + 1 AS n_required, CASE WHEN cn = sn THEN 1 ELSE 0 END + CASE WHEN ca = sa THEN 1 ELSE 0 END AS n_matched FROM (WITH """ + PAIRS + """ SELECT * FROM b))""")
def present_equality(t):
    """Only fields that gold reports are required; a pair is accepted if all of them agree."""
    required = F.when(F.col("cn").isNotNull(), 1).otherwise(0) + 1
    matched = F.when(F.col("cn") == F.col("sn"), 1).otherwise(0) + F.when(F.col("ca") == F.col("sa"), 1).otherwise(0)
    return pairs(t).select("c_custkey", "s_suppkey", required.cast("long").alias("n_required"), matched.alias("n_matched"), (required == matched).alias("accepted"))


@query("jn32_attachment_diagnosis", """SELECT o_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = o_custkey % 7 AND l_suppkey % 3 = o_custkey % 3 THEN 'right' WHEN l_partkey % 7 = o_custkey % 7 THEN 'wrong arm' WHEN l_suppkey % 3 = o_custkey % 3 THEN 'wrong outcome' ELSE 'both' END AS diagnosis FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def attachment_diagnosis(t):
    both = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    part, supplier = F.col("l_partkey") % 7 == F.col("o_custkey") % 7, F.col("l_suppkey") % 3 == F.col("o_custkey") % 3
    return both.select("o_orderkey", "l_linenumber", F.when(part & supplier, "right").when(part, "wrong arm").when(supplier, "wrong outcome").otherwise("both").alias("diagnosis"))


@query("jn41_jn42_role_overlay", """SELECT n_nationkey, CASE WHEN s.n = 1 THEN s.v ELSE n_name END AS label, n_regionkey AS count_kept FROM nation LEFT JOIN (SELECT s_nationkey, count(DISTINCT s_name) AS n, min(s_name) AS v FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s ON s_nationkey = n_nationkey""")
def role_overlay(t):
    """Returned labels replace ours where they do not conflict; counts are never taken from them."""
    told = t.supplier.filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.countDistinct("s_name").alias("n"), F.min("s_name").alias("v"))
    both = t.nation.join(told, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return both.select("n_nationkey", F.when(F.col("n") == 1, F.col("v")).otherwise(F.col("n_name")).alias("label"), F.col("n_regionkey").alias("count_kept"))


@query("gr03_complete_link")
def complete_link(t):
    """Line items of an order whose quantities lie close, grouped so that all members do."""
    # All that follows is by order, so rows are dealt once.
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    other = lines.select("l_orderkey", F.col("l_linenumber").alias("b"), F.col("q").alias("p"))
    near = lines.join(other, "l_orderkey").filter("l_linenumber < b AND abs(q - p) <= 10").select("l_orderkey", F.col("l_linenumber").alias("a"), "b")
    return identity.complete_link(near, lines, "l_orderkey", "l_linenumber")


@query("nm21_nm23_vocabularies", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'mean' WHEN 1 THEN 'risk_ratio' WHEN 2 THEN 'event_count' END AS statistic, CASE p_partkey % 3 WHEN 0 THEN 'ITT' WHEN 1 THEN 'PPS' ELSE 'mITT' END AS analysis FROM part""")
def vocabularies(t):
    pick = lambda *names: F.get(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names)).cast("int"))
    return t.part.select(
        "p_partkey", cells.vocabulary(pick(" Mean  Value", "RR", "events", "unheard of"), cells.STATISTIC_NAMES).alias("statistic"), cells.vocabulary(pick("Intention-to-treat", "per protocol", "Modified ITT"), cells.ANALYSIS_NAMES).alias("analysis")
    )


@query("nm27_typed_observations", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'NOT_APPLICABLE' WHEN 1 THEN 'NOT_REPORTED' WHEN 2 THEN 'PRESENT' ELSE 'REVIEW_REQUIRED' END AS status, CASE WHEN s_suppkey % 4 = 2 THEN s_nationkey::DOUBLE END AS value FROM supplier""")
def typed_observations(t):
    raw = F.when(F.col("s_suppkey") % 4 == 0, " n/a").when(F.col("s_suppkey") % 4 == 1, "NR").when(F.col("s_suppkey") % 4 == 2, F.col("s_nationkey").cast("string")).otherwise("about nine")
    seen = cells.observation(raw)
    return t.supplier.select("s_suppkey", seen["status"].alias("status"), seen["value"].alias("value"))


@query("nm12_derived_durations", """SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE END, p_partkey::DOUBLE / nullif(p_size % 4, 0)) AS weeks FROM part""")
def derived_durations(t):
    told = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double"))
    return t.part.select("p_partkey", cells.weekly_duration(F.col("p_partkey").cast("double"), (F.col("p_size") % 4).cast("double"), told).alias("weeks"))


@query("st57_st60_feature_rows", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'non_invasive_sham' WHEN 1 THEN 'invasive_sham' WHEN 2 THEN 'waiting_list' ELSE 'NR' END AS control, CASE WHEN p_size % 2 = 0 THEN p_size // 2 END AS arm_size FROM part""")
def feature_rows(t):
    told = F.get(F.array(*[F.lit(x) for x in ("Non-penetrating sham", "sham needle", "waiting list", "nothing said")]), (F.col("p_partkey") % 4).cast("int"))
    return t.part.select("p_partkey", cells.control_kind(told).alias("control"), cells.arm_sizes(F.col("p_size"))[0].alias("arm_size"))


@query("st19_st66_verbatim_support", """SELECT doc_id, strpos(trim(regexp_replace(text, '\\s+', ' ', 'g')), substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 5, 20)) > 0 AS supported FROM documents""")
def verbatim_support(t):
    from lumenweave.functions.text import collapse

    quote = F.substring(collapse(F.col("text")), 5, 20)
    return t.documents.select("doc_id", cells.verbatim(quote, F.concat(F.lit("  "), "text")).alias("supported"))


@query("so03_so07_slot_digests", """SELECT o_orderkey, substr(sha256(o_orderkey || '|' || coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '')), 1, 16) AS digest FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def slot_digests(t):
    both = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    slots = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: F.concat(x["l_linenumber"], F.lit(":"), x["l_returnflag"]))
    return both.groupBy("o_orderkey").agg(F.array_join(slots, ",").alias("s")).select("o_orderkey", F.substring(F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.lit("|"), "s"), 256), 1, 16).alias("digest"))


@query("so06_kind_stability", """SELECT event_type, min(n) AS least, max(n) AS most, max(n) - min(n) AS span, count(*) AS n_runs FROM (SELECT event_type, event_id % 3 AS run, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type""")
def kind_stability(t):
    runs = t.events.groupBy("event_type", (F.col("event_id") % 3).alias("run")).agg(F.count("*").alias("n"))
    return runs.groupBy("event_type").agg(F.min("n").alias("least"), F.max("n").alias("most"), (F.max("n") - F.min("n")).alias("span"), F.count("*").alias("n_runs"))


@query("so17_so25_invariance_guard", """SELECT n_regionkey, count(*) AS n, sum(n_nationkey)::BIGINT AS ids, count(*) FILTER (n_name <> upper(n_name)) AS changed, count(*) FILTER (n_name <> upper(n_name)) = 0 AS unchanged FROM nation GROUP BY n_regionkey""")
def invariance_guard(t):
    """A replay may only change the allowed field: keys and counts are compared, changes counted."""
    after = t.nation.withColumn("m", F.upper("n_name"))
    changed = F.count_if(F.col("n_name") != F.col("m"))
    return after.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("ids"), changed.alias("changed"), (changed == 0).alias("unchanged"))


@query("wn06_derived_consistency", """SELECT l_orderkey, l_linenumber, CASE WHEN derived AND NOT formula THEN 'no formula' WHEN formula AND NOT derived THEN 'no flag' ELSE 'consistent' END AS verdict FROM (SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS derived, l_quantity > 25 AS formula FROM lineitem)""")
def derived_consistency(t):
    derived, formula = F.col("l_linenumber") % 2 == 0, F.col("l_quantity") > 25
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(derived & ~formula, "no formula").when(formula & ~derived, "no flag").otherwise("consistent").alias("verdict"))


@query("wn12_chunk_numbers", """SELECT doc_id, n, length(x) AS n_chars FROM (SELECT doc_id, unnest(range(1, 1 + (length(text) + 999) // 1000)) AS n, text FROM documents), LATERAL (SELECT substr(text, ((n - 1) * 1000 + 1)::INT, 1000) AS x)""")
def chunk_numbers(t):
    n = F.explode(F.sequence(F.lit(1), F.ceil(F.length("text") / 1000)))
    chunks = t.documents.filter("length(text) > 0").select("doc_id", "text", n.alias("n"))
    return chunks.select("doc_id", "n", F.length(F.expr("substr(text, CAST((n - 1) * 1000 + 1 AS INT), 1000)")).alias("n_chars"))


@query("ag20_ag27_batch_summary", """SELECT o_orderpriority, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS review, round(count(*) FILTER (ok)::DOUBLE / count(*), 9) AS pass_rate FROM (SELECT o_orderpriority, o_totalprice > 100000 AS ok FROM orders) GROUP BY o_orderpriority""")
def batch_summary(t):
    ok = F.col("o_totalprice") > 100000
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("review"), F.round(F.count_if(ok) / F.count("*"), 9).alias("pass_rate"))


@query("ag28_ag38_layer_counts", """SELECT layer, n, coalesce(lag(n) OVER (ORDER BY layer) - n, 0) AS lost FROM (SELECT 1 AS layer, count(*) AS n FROM orders UNION ALL SELECT 2, count(DISTINCT o_orderkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 3, count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R')""")
def layer_counts(t):
    """How many entities each layer of a cascade keeps, and how many it loses."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    counts = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").agg(F.count("*").alias("a"), F.count("l_orderkey").alias("b"), F.count_if("r").alias("c"))
    layers = counts.select(F.inline(F.array(*[F.struct(F.lit(i).alias("layer"), F.col(c).alias("n")) for i, c in enumerate("abc", 1)])))
    before = F.lag("n").over(Window.partitionBy(F.lit(0)).orderBy("layer"))  # three rows
    return layers.select("layer", "n", F.coalesce(before - F.col("n"), F.lit(0)).alias("lost"))


@query("pf11_pf13_row_selection", """SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS n FROM lineitem WHERE l_linestatus = 'O') WHERE n = 1""")
def row_selection(t):
    """Rows of the wanted category, repeated ones once."""
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey"))
    return t.lineitem.filter("l_linestatus = 'O'").withColumn("n", n).filter("n = 1").select("l_orderkey", "l_linenumber")


@query("pf07_pf08_lookup_with_fallback", """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'document' ELSE 'label' END AS found_in FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def lookup_with_fallback(t):
    l = t.labels.select(F.col("doc_id").alias("l_id"), "quality")
    return t.documents.join(l, F.col("l_id") == F.col("doc_id"), "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("l_id").isNull(), "document").otherwise("label").alias("found_in"))


@query("pf20_applicability", """SELECT l_orderkey, CASE WHEN bool_and(l_tax > 0) AND count(*) FILTER (l_discount > 0) = 0 THEN 'NOT_APPLICABLE' WHEN bool_or(l_tax > 0) AND bool_or(l_discount > 0) THEN 'ABSTAIN' ELSE 'OPEN' END AS slot FROM lineitem GROUP BY l_orderkey""")
def applicability(t):
    tax, discount = F.col("l_tax") > 0, F.col("l_discount") > 0
    return t.lineitem.groupBy("l_orderkey").agg(F.when(F.bool_and(tax) & (F.count_if(discount) == 0), "NOT_APPLICABLE").when(F.bool_or(tax) & F.bool_or(discount), "ABSTAIN").otherwise("OPEN").alias("slot"))


@query("pf24_best_evidence", """SELECT conv_id, max(CASE WHEN text IS NULL OR text = '' THEN 0e0 WHEN length(text) < 20 THEN 5e-1 ELSE 1e0 END) AS score FROM conversations GROUP BY conv_id""")
def best_evidence(t):
    score = F.when(F.coalesce("text", F.lit("")) == "", 0.0).when(F.length("text") < 20, 0.5).otherwise(1.0)
    return t.conversations.groupBy("conv_id").agg(F.max(score).alias("score"))


@query("pl05_pl22_resume_plan", """SELECT o_orderkey, CASE WHEN l.n IS NULL THEN 'run' WHEN l.n < 2 THEN 'retry' ELSE 'done' END AS plan FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1) l ON l_orderkey = o_orderkey""")
def resume_plan(t):
    done = t.lineitem.filter("l_quantity > 10").groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("n"))
    both = t.orders.join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return both.select("o_orderkey", F.when(F.col("n").isNull(), "run").when(F.col("n") < 2, "retry").otherwise("done").alias("plan"))


@query("pl18_pl19_trace_rollup", """SELECT user_id, CASE WHEN count(DISTINCT event_type) = 5 THEN 'AVAILABLE' WHEN count(*) > 0 THEN 'PARTIAL' ELSE 'NOT_AVAILABLE' END AS trace, max(event_id) AS last_event FROM events WHERE value < 50 GROUP BY user_id""")
def trace_rollup(t):
    kept = t.events.filter("value < 50")
    return kept.groupBy("user_id").agg(F.when(F.countDistinct("event_type") == 5, "AVAILABLE").when(F.count("*") > 0, "PARTIAL").otherwise("NOT_AVAILABLE").alias("trace"), F.max("event_id").alias("last_event"))
