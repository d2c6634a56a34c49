"""Entities of two graphs matched kind by kind, each kind within what its parents were matched to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.shared import written

#: The kinds of entities, those of one level depending only on earlier levels.
LEVELS = (("Article",), ("Study",), ("Arm", "Outcome"), ("Intervention", "Comparison"), ("ArmResult", "ComparisonResult"))
#: Kinds whose ids are reserved before names are asked, whose parents have no order, and whose splits and merges have names.
RESERVED, UNORDERED, FOLDED = ("Arm",), ("Intervention",), ("Outcome",)
#: Limits: entities of more parents are joined by rows, and kinds with more matches by a shuffle.
WIDE, FEW = 4, 200_000
PLACED = "array<struct<at:int,kind:string,id:string>>"
ENTITY = "kind string, id string, refs array<struct<kind:string,id:string,reason:string>>, fixed string, keys array<struct<value:string,method:string>>, blocked string"


def ref(kind: str, id: Column, reason: str | None = None) -> Column:
    """A parent that an entity names; ``reason`` is told where it is not matched, else the entity is only EXTRA."""
    return F.struct(F.lit(kind).alias("kind"), id.cast("string").alias("id"), F.lit(reason).cast("string").alias("reason"))


def entity(rows: DataFrame, kind: str, id: Column, refs: list[Column], names: dict[str, Column] | None = None, fixed: Column | None = None, blocked: Column | None = None) -> DataFrame:
    """Rows as entities.  ``names`` maps a method to the name that it compares (null: none); without names the parents and ``fixed`` are the identity."""
    keys = [F.struct(v.cast("string").alias("value"), F.lit(m).alias("method")) for m, v in (names or {"COMPOSITE_IDENTITY": F.lit("")}).items()]
    none = F.lit(None).cast("string")
    held = F.array(*refs) if refs else F.from_json(F.lit("[]"), "array<struct<kind:string,id:string,reason:string>>")
    # Where no parent can be null, as the optimizer sees, nothing is left out one by one.
    whole = F.when(reduce(lambda a, r: a & r.isNotNull(), refs, F.lit(True)), held).otherwise(F.array_compact(held))
    return rows.select(
        F.lit(kind).alias("kind"), id.cast("string").alias("id"), whole.alias("refs"), (none if fixed is None else fixed).alias("fixed"), F.array(*keys).alias("keys"), (none if blocked is None else blocked).alias("blocked"),
    )


def _placed(kind: Column, at: Column, parent: Column, id: Column) -> Column:
    return F.struct(F.when(kind.isin(*UNORDERED), F.lit(0)).otherwise(at).alias("at"), parent.alias("kind"), id.alias("id"))


def _with_reserved(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Where the other side has the id too, that id is the only key."""
    there = others.filter(F.col("kind").isin(*RESERVED)).select("kind", "id").distinct().withColumn("_there", F.lit(True))
    only = F.array(F.struct(F.concat(F.lit("id:"), "id").alias("value"), F.lit("EXACT_ID").alias("method")))
    asked = rows.filter(F.col("kind").isin(*RESERVED)).join(there, ["kind", "id"], "left").withColumn("keys", F.when(F.col("_there"), only).otherwise(F.col("keys"))).drop("_there")
    return asked.unionByName(rows.filter(~F.col("kind").isin(*RESERVED)))


def _signed(rows: DataFrame, gold: bool, free: Column) -> DataFrame:
    """(kind, gold, id, why, method, s1, s2, n): one row an entity and a signature that it may be matched by; ``n`` is the number of its signatures.

    A signature has two hashes of 64 bits.  Entities without one, or not
    ``free``, have one row with no ``s2``, spread by their ids.
    """
    known = F.col("id").isNotNull() & free
    refs = F.when(F.col("kind").isin(*UNORDERED), F.sort_array("refs")).otherwise(F.col("refs"))
    # Nulls, which hashes pass over, stand in gold entities that match nothing and at the places of parents that there are not.
    base = [F.xxhash64(F.lit(seed), "kind", "parents", F.col("refs")["kind"], F.col("refs")["id"], F.col("fixed").isNull(), "fixed") for seed in (1, 2)]
    single = F.when(known & F.get("keys", F.lit(0))["value"].isNotNull(), F.col("keys"))
    asked = F.when(F.size("keys") == 1, single).otherwise(F.filter("keys", lambda k: known & k["value"].isNotNull()))
    each = rows.withColumn("refs", refs).select("kind", "id", "blocked", base[0].alias("b1"), base[1].alias("b2"), asked.alias("asked"))
    n = F.when(F.size("asked") > 1, F.size(F.array_distinct(F.col("asked")["value"]))).otherwise(1)
    each = each.select("kind", "id", "blocked", "b1", "b2", n.alias("n"), F.explode_outer("asked").alias("k"))
    lone = F.col("k.value").isNull()
    return each.select(
        "kind", F.lit(gold).alias("gold"), "id", F.col("blocked").alias("why"), "k.method",
        F.when(lone, F.xxhash64("id")).otherwise(F.xxhash64("b1", "k.value")).alias("s1"), F.when(~lone, F.xxhash64("b2", "k.value")).alias("s2"), "n",
    )


def _joined(pred: DataFrame, mapping: dict[str, DataFrame], counts: dict[str, int], shapes: list[list[str | None]]) -> DataFrame:
    """Predicted entities of few parents with these parents' gold ids, by a join for each place in ``refs``; ``shapes`` has the kinds that stand together."""
    width = max(map(len, shapes), default=0)
    rows = pred
    for i in range(width):
        at = F.get("refs", F.lit(i))
        rows = rows.withColumns({f"k{i}": at["kind"], f"r{i}": at["id"], f"w{i}": at["reason"]})
    rows = rows.withColumn("parents", F.size("refs")).drop("refs")
    places = {i: {s[i] for s in shapes if len(s) > i} & set(counts) for i in range(width)}
    few = {kind for kind, n in counts.items() if n <= FEW}
    steps = [(i, part, here) for part, wanted in ((True, few), (False, set(counts) - few)) for i in range(width) if (here := places[i] & wanted)]
    golds: dict[int, list[str]] = {i: [] for i in range(width)}
    for i, small, here in steps:
        name = f"g{i}_{int(small)}"
        golds[i].append(name)
        told = reduce(DataFrame.union, [mapping[kind] for kind in sorted(here)]).toDF("_kind", "_pred", name)
        # Rows without this parent are spread by their own ids.
        met = (F.coalesce(f"r{i}", "id") == F.col("_pred")) & (F.col(f"k{i}") == F.col("_kind")) & F.col(f"r{i}").isNotNull()
        rows = rows.join(F.broadcast(told) if small else told, met, "left").drop("_kind", "_pred")
    none = F.lit(None).cast("string")
    gold = {i: F.coalesce(*golds[i], none) for i in range(width)}
    held = [F.when(F.col("parents") > i, _placed(F.col("kind"), F.lit(i), F.col(f"k{i}"), gold[i])) for i in range(width)]
    lost = [(F.col("parents") > i) & gold[i].isNull() for i in range(width)]
    why = F.when(F.col("id").isNotNull(), F.coalesce(*[F.when(lost[i], F.col(f"w{i}")) for i in range(width)], none))
    free = reduce(lambda a, x: a & ~x, lost, F.col("blocked").isNull())
    refs = F.array(*held) if held else F.from_json(F.lit("[]"), PLACED)
    return rows.select("kind", "id", refs.alias("refs"), "parents", "fixed", "keys", F.coalesce("blocked", why).alias("blocked"), free.alias("free"))


def _exploded(pred: DataFrame, mapping: dict[str, DataFrame]) -> DataFrame:
    """What ``_joined`` gives, for entities of any number of parents: these are joined as rows and gathered again."""
    each = pred.select("kind", "id", F.posexplode("refs").alias("at", "ref"))
    none = pred.limit(0).select("kind", "id", "id")
    told = reduce(DataFrame.union, mapping.values(), none).toDF("_kind", "_pred", "_gold")
    met = each.join(told, (F.col("ref.kind") == F.col("_kind")) & (F.col("ref.id") == F.col("_pred")), "left")
    lost = F.col("_gold").isNull()
    per = met.groupBy("kind", "id").agg(
        F.sort_array(F.collect_list(_placed(F.col("kind"), F.col("at"), F.col("ref.kind"), F.col("_gold")))).alias("bound"),
        F.count_if(lost).alias("lost"),
        F.min(F.when(lost & F.col("ref.reason").isNotNull(), F.struct("at", "ref.reason")))["reason"].alias("why"),
    )
    rows = pred.join(per, ["kind", "id"], "left")
    free = F.col("blocked").isNull() & (F.coalesce("lost", F.lit(0)) == 0)
    return rows.select("kind", "id", F.coalesce("bound", F.from_json(F.lit("[]"), PLACED)).alias("refs"), F.size("refs").alias("parents"), "fixed", "keys", F.coalesce("blocked", "why").alias("blocked"), free.alias("free"))


def _bound(pred: DataFrame, mapping: dict[str, DataFrame], counts: dict[str, int]) -> DataFrame:
    """Predicted entities with their parents' gold ids; ``free`` where all are known."""
    slim = F.size("refs") <= WIDE
    found = pred.select(F.when(slim, F.col("refs")["kind"]).alias("s")).distinct().collect()
    shapes = [r.s for r in found if r.s is not None]
    if len(shapes) == len(found):
        return _joined(pred, mapping, counts, shapes)
    return _joined(pred.filter(slim), mapping, counts, shapes).unionByName(_exploded(pred.filter(~slim), mapping))


def _judged(rows: DataFrame) -> DataFrame:
    """``_signed`` rows of both sides with ``status`` and, for a matched gold entity, ``other``, its predicted one.

    Where no entity of a signature has another signature, its entities are a
    component, and their numbers on both sides are its shape.  The rest is
    ``loose`` and keeps its signature.
    """
    alike = Window.partitionBy("s1", "s2")
    gold, pred = F.when(F.col("gold"), F.col("id")), F.when(~F.col("gold"), F.col("id"))
    met = rows.withColumns(
        {"ng": F.count(gold).over(alike), "np": F.count(pred).over(alike), "g0": F.min(gold).over(alike), "g1": F.max(gold).over(alike), "p0": F.min(pred).over(alike), "p1": F.max(pred).over(alike), "most": F.max("n").over(alike)}
    )
    twice = ((F.col("ng") > 1) & (F.col("g0") == F.col("g1"))) | ((F.col("np") > 1) & (F.col("p0") == F.col("p1")))
    loose = F.col("s2").isNotNull() & ((F.col("most") > 1) | F.coalesce(twice, F.lit(False)))
    alone = F.col("s2").isNull() | (F.col("ng") == 0) | (F.col("np") == 0)
    named = F.col("kind").isin(*FOLDED)
    status = (
        F.when(alone, F.when(F.col("gold"), "MISSING").otherwise("EXTRA"))
        .when((F.col("ng") == 1) & (F.col("np") == 1), "MATCHED")
        .when(named & (F.col("ng") == 1), "SPLIT")
        .when(named & (F.col("np") == 1), "MERGED")
        .otherwise("AMBIGUOUS")
    )
    matched = ~F.col("loose") & (F.col("status") == "MATCHED")
    told = met.select("*", loose.alias("loose"), status.alias("status")).filter(F.col("gold") | ~matched)
    kept = lambda c, of: F.when(of, F.col(c)).alias(c)
    return told.select("kind", "gold", "id", "why", kept("method", matched | F.col("loose")), F.when(matched, F.col("p0")).alias("other"), kept("status", ~F.col("loose")), "loose", kept("s1", F.col("loose")), kept("s2", F.col("loose")))


def _forest(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(kind, gold_id, pred_id, method): edges that span what shares a signature.

    All gold entities of a signature meet its least predicted one and the other
    way round: as many rows as entities, never their product, and the same
    components; a pair alone, or one entity with several, has all its edges.
    """
    sig = ["kind", "s1", "s2"]
    g0, p0 = gold.groupBy(*sig).agg(F.min("gold_id").alias("gold_id")), pred.groupBy(*sig).agg(F.min("pred_id").alias("pred_id"))
    one = gold.join(p0, sig).select("kind", "gold_id", "pred_id", "method")
    two = pred.join(g0, sig).select("kind", "gold_id", "pred_id", F.lit(None).cast("string"))
    return one.union(two).groupBy("kind", "gold_id", "pred_id").agg(F.max("method").alias("method"))


def _shaped(edges: DataFrame) -> DataFrame:
    """Edges with the status that their component's shape gives, told from the degrees of both ends and of their neighbours."""

    def per(rows: DataFrame, end: str, what: Column, name: str) -> DataFrame:
        return rows.join(rows.groupBy("kind", end).agg(what.alias(name)), ["kind", end])

    rows = per(per(edges, "gold_id", F.count("*"), "dg"), "pred_id", F.count("*"), "dp")
    rows = per(per(rows, "gold_id", F.max("dp"), "around_gold"), "pred_id", F.max("dg"), "around_pred")
    named = F.col("kind").isin(*FOLDED)
    status = (
        F.when((F.col("dg") == 1) & (F.col("dp") == 1), "MATCHED")
        .when(named & (F.col("around_gold") == 1), "SPLIT")
        .when(named & (F.col("around_pred") == 1), "MERGED")
        .otherwise("AMBIGUOUS")
    )
    return rows.select("kind", "gold_id", "pred_id", "method", status.alias("status"))


def _loosely(rows: DataFrame) -> DataFrame:
    """``_judged`` for its loose rows, whose components reach over several signatures."""
    side = lambda gold, end: rows.filter(F.col("gold") == gold).select("kind", "s1", "s2", F.col("id").alias(end), "method")
    edges = _forest(side(True, "gold_id"), side(False, "pred_id").drop("method"))
    judged = written(_shaped(written(edges, "edges")), "shaped")
    matched = F.col("status") == "MATCHED"
    by = lambda gold, end, other: judged.groupBy("kind", F.lit(gold).alias("gold"), F.col(end).alias("id")).agg(F.min("status").alias("status"), F.max(F.when(matched, F.col("method"))).alias("method"), F.max(F.when(matched, F.col(other))).alias("other"))
    ends = by(True, "gold_id", "pred_id").unionByName(by(False, "pred_id", "gold_id"))
    each = rows.groupBy("kind", "gold", "id").agg(F.max("why").alias("why")).join(ends, ["kind", "gold", "id"], "left")
    return each.withColumn("status", F.coalesce("status", F.when(F.col("gold"), "MISSING").otherwise("EXTRA"))).filter(F.col("gold") | ~matched)


def _results(rows: DataFrame) -> DataFrame:
    """Judged entities as rows of the result."""
    told = {"MISSING": F.lit("ENTITY_MISSING"), "EXTRA": F.coalesce("why", F.lit("ENTITY_EXTRA")), "AMBIGUOUS": F.lit("ENTITY_AMBIGUOUS"), "SPLIT": F.lit("OUTCOME_IDENTITY_SPLIT"), "MERGED": F.lit("OUTCOME_IDENTITY_MERGE")}
    reason = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in told.items()])
    ends = F.when(F.col("gold"), F.col("id")).alias("gold_id"), F.when(F.col("gold"), F.col("other")).otherwise(F.col("id")).alias("pred_id")
    return rows.select("kind", *ends, "status", "method", reason.alias("reason"))


def match_entities(gold: DataFrame, pred: DataFrame, levels: tuple[tuple[str, ...], ...] = LEVELS) -> DataFrame:
    """(kind, gold_id, pred_id, status, method, reason) of all entities of both sides (``ENTITY``).

    A level's entities meet within the gold ids of their parents, by id, name or
    composite identity, and only components of one gold and one predicted
    entity are MATCHED and bind the levels below.  The rest is MISSING, EXTRA
    (with the reason of the first parent that is not matched), AMBIGUOUS, or for
    outcomes SPLIT and MERGED.  A kind's ids are distinct on each side; a null
    id matches nothing.  Both sides are read anew by each level, so that what
    is costly to compute should be written first.
    """
    mapping: dict[str, DataFrame] = {}
    counts: dict[str, int] = {}
    out = []
    for kinds in levels:
        g, p = gold.filter(F.col("kind").isin(*kinds)), pred.filter(F.col("kind").isin(*kinds))
        if set(kinds) & set(RESERVED):
            g, p = _with_reserved(g, p), _with_reserved(p, g)
        rows = _signed(g.withColumn("parents", F.size("refs")), True, F.lit(True)).unionByName(_signed(_bound(p, mapping, counts), False, F.col("free")))
        told = written(_judged(rows), "judged")
        loose, plain = told.filter("loose"), told.filter("NOT loose")
        results = [_results(plain)]
        if not loose.isEmpty():
            results.append(written(_results(_loosely(loose)), "loose"))
        done = reduce(DataFrame.unionByName, results)
        matched = done.filter("status = 'MATCHED'").select("kind", "pred_id", "gold_id")
        counts |= {r.kind: r["count"] for r in matched.groupBy("kind").count().collect()}
        mapping |= {kind: matched.filter(F.col("kind") == kind) for kind in set(kinds) & set(counts)}
        out.append(done)
    return reduce(DataFrame.unionByName, out)
