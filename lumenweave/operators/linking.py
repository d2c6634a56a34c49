"""Links under constraints, decided by counts of candidates instead of lists of them.

Two rows are compatible if they agree on all exact columns and on each loose
column that both know.  Whether a row has no, one or several compatible rows on
the other side is found without pairing them: a row is looked up once for each
pattern of known columns that the other side may have, among rows that are
counted by their values under it.  A link is made where both sides have one
candidate, so only such pairs are ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.operators import graph
from lumenweave.shared import written


def _keyed(rows: DataFrame, exact: list[str], loose: list[str], left: bool) -> DataFrame:
    """(id, key columns): ``rows`` once for each pattern of known loose columns of the other side."""
    known = sum((F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(loose)), F.lit(0))
    wide = rows.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in exact)) if exact else rows
    wide = wide.select("id", *exact, *loose, known.alias("own"), F.explode(F.sequence(F.lit(0), F.lit((1 << len(loose)) - 1))).alias("other"))
    both = F.col("own").bitwiseAND(F.col("other"))
    shared = [F.when(both.bitwiseAND(1 << i) != 0, F.col(c).cast("string")).otherwise("").alias(f"v{i}") for i, c in enumerate(loose)]
    patterns = ("own", "other") if left else ("other", "own")
    return wide.select("id", *exact, *[F.col(p).alias(n) for p, n in zip(patterns, ("l", "r"), strict=True)], *shared)


def candidates(left: DataFrame, right: DataFrame, exact: list[str], loose: list[str], flip: bool = False) -> DataFrame:
    """(id, degree, partner) of the rows of ``left`` that have compatible rows in ``right``; ``partner`` is the only or least one.

    Both have id and the columns named; a null in an exact column is compatible with nothing.
    """
    keys = [*exact, "l", "r", *[f"v{i}" for i in range(len(loose))]]
    counted = _keyed(right, exact, loose, flip).groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    met = _keyed(left, exact, loose, not flip).join(counted, keys)
    return met.groupBy("id").agg(F.sum("n").alias("degree"), F.min("first").alias("partner"))


def both_ways(left: DataFrame, right: DataFrame, exact: list[str], loose: list[str]) -> tuple[DataFrame, DataFrame]:
    """Candidates of either side, with ``unique``: this row and its partner have no other."""
    of_left, of_right = candidates(left, right, exact, loose), candidates(right, left, exact, loose, flip=True)
    return _marked(of_left, of_right), _marked(of_right, of_left)


def _marked(one: DataFrame, two: DataFrame) -> DataFrame:
    alone = two.filter("degree = 1").select(F.col("id").alias("partner"), F.lit(True).alias("back"))
    return one.join(alone, "partner", "left").select("id", "degree", "partner", ((F.col("degree") == 1) & F.coalesce("back", F.lit(False))).alias("unique"))


def alias_groups(rows: DataFrame, hints: DataFrame) -> DataFrame:
    """``rows`` with ``group``, the least id that hints (u, v) of being the same connect a row with; its own without any."""
    found = graph.components(hints).select(F.col("node").alias("id"), F.col("component").alias("group"))
    return rows.join(found, "id", "left").withColumn("group", F.coalesce("group", "id"))


def link_groups(predicted: DataFrame, reference: DataFrame, locks: DataFrame, exact: list[str], loose: list[str]) -> DataFrame:
    """(side, id, status, other) of every reference row and every group of predictions.

    ``predicted``: id, group (the id of its representative, whose columns count), blocked and the columns compared;
    ``reference`` likewise without group; ``locks`` (gold, pred): links made earlier, which are must-links.  A group
    with one locked reference is LINKED with it, one with several is BLOCKED as a whole: grouping does not overturn
    identities told apart before.  Of what is left, LINKED is unique both ways; a reference row is SPLIT with several
    groups, MERGED with one that has other candidates too, MISSING without; a group is SPLIT with any, EXTRA without.
    """
    members = predicted.select(F.col("id").alias("pred"), "group")
    targets = locks.join(members, "pred").groupBy("group").agg(F.countDistinct("gold").alias("n"), F.min("gold").alias("gold"))
    locked = locks.groupBy(F.col("gold").alias("id")).agg(F.min("pred").alias("other"))
    free_groups = predicted.filter("id = group AND NOT blocked").join(targets.select("group"), "group", "left_anti")
    free_rows = reference.filter("NOT blocked").join(locked, "id", "left_anti")
    rows, groups = both_ways(free_rows, free_groups, exact, loose)

    linked = F.when(F.col("unique"), F.col("partner"))
    gold = reference.select("id").join(locked, "id", "left").join(rows, "id", "left")
    gold_status = F.when(F.col("other").isNotNull() | F.col("unique"), "LINKED").when(F.col("degree") > 1, "SPLIT").when(F.col("degree") == 1, "MERGED").otherwise("MISSING")
    heads = predicted.select(F.col("group").alias("id")).distinct()
    pred = heads.join(targets.withColumnRenamed("group", "id"), "id", "left").join(groups, "id", "left")
    pred_status = F.when(F.col("n") > 1, "BLOCKED").when((F.col("n") == 1) | F.col("unique"), "LINKED").when(F.col("degree") > 0, "SPLIT").otherwise("EXTRA")
    told = F.when(F.col("n") == 1, F.col("gold")).when(F.col("n").isNull(), linked)
    return gold.select(F.lit("reference").alias("side"), "id", gold_status.alias("status"), F.coalesce("other", linked).alias("other")).unionByName(
        pred.select(F.lit("group").alias("side"), "id", pred_status.alias("status"), told.alias("other"))
    )


#: Dimensions in the order in which they narrow candidates, each with the reason given on either side where it leaves none.
NARROWING = (
    ("parent", "MISSING_RESULT_IN_PREDICTION", "NO_CANDIDATE"),
    ("outcome", "MISSING_RESULT_IN_PREDICTION", "OUTCOME_CONTRADICTION"),
    ("timepoint", "TIMEPOINT_CONTRADICTION", "TIMEPOINT_CONTRADICTION"),
    ("analysis_set", "ANALYSIS_SET_CONTRADICTION", "ANALYSIS_SET_CONTRADICTION"),
    ("statistic_kind", "STATISTIC_KIND_CONTRADICTION", "STATISTIC_KIND_CONTRADICTION"),
    ("derived", "DERIVED_CONTRADICTION", "DERIVED_CONTRADICTION"),
)
EXACT = ("kind", "parent", "outcome", "derived")
LOOSE = ("timepoint", "analysis_set", "statistic_kind")


def link_results(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(side, id, status, other, reason): results matched over seven dimensions, accepted where unique and safe.

    Both have id, kind, parent, outcome, derived, timepoint, analysis_set, statistic_kind (null: unknown) and blocker
    (null: none); parent and outcome of predictions are mapped to the reference's already, null where unmapped.  All
    dimensions must agree or, for the last three of them, be unknown on a side.  Unknown timepoints or statistics and
    blockers make a candidate unsafe: it is never accepted, and its rivals are not either.
    """
    gold, pred = written(gold, "gold"), written(pred, "pred")
    own = {"reference": gold, "prediction": pred}
    sides, narrowed = _looked_up(gold, pred)
    out = None
    for side, other in (("reference", "prediction"), ("prediction", "reference")):
        theirs = own[other].select(F.col("id").alias("partner"), *[F.col(c).alias(f"o_{c}") for c in ("timepoint", "statistic_kind", "blocker")])
        rows = own[side].join(sides[side], "id", "left").join(theirs, "partner", "left")
        known = lambda c: F.col(c).isNotNull() & F.col(f"o_{c}").isNotNull()
        safe = known("timepoint") & known("statistic_kind") & F.col("blocker").isNull() & F.col("o_blocker").isNull()
        accepted = F.coalesce(F.col("unique") & safe, F.lit(False))
        one = F.coalesce(F.col("degree") == 1, F.lit(False))
        # Why a row with candidates stays open: several, a blocker of its own, then what is not known of the pair.
        open_reason = (
            F.when(~one | safe, "MULTIPLE_SAFE_CANDIDATES").when(F.col("blocker").isNotNull(), F.col("blocker")).when(~known("timepoint"), "TIMEPOINT_AMBIGUOUS")
            .when(~known("statistic_kind"), "STATISTIC_KIND_AMBIGUOUS").otherwise("ANALYSIS_SET_AMBIGUOUS")
        )
        told = rows.select("id", accepted.alias("accepted"), F.col("degree").isNotNull().alias("some"), "partner", "parent", "outcome", open_reason.alias("open_reason"))
        told = told.join(narrowed[side], "id", "left")
        if side == "prediction":
            unmapped = F.when(F.col("parent").isNull(), "MISSING_PARENT").when(F.col("outcome").isNull(), "OUTCOME_AMBIGUOUS")
        else:
            unmapped = F.lit(None).cast("string")
        none = "MISSING" if side == "reference" else "EXTRA"
        found = told.select(
            F.lit(side).alias("side"), "id", F.when(F.col("accepted"), "MATCHED").when(F.col("some"), "AMBIGUOUS").otherwise(none).alias("status"),
            F.when(F.col("accepted"), F.col("partner")).alias("other"),
            F.when(F.col("accepted"), "UNIQUE_SAFE_RESULT_LINK").when(F.col("some"), F.col("open_reason")).otherwise(F.coalesce(unmapped, "reason")).alias("reason"),
        )
        out = found if out is None else out.unionByName(found)
    return out


#: Pairs of results of one parent up to which they are looked at one by one; of more, rows are counted by their values.
PAIRS = 256


def _looked_up(gold: DataFrame, pred: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """By side: (id, degree, partner, unique) of the rows with candidates, and (id, reason) of all.

    Most parents have few results, and one join of those answers for all dimensions at once.
    """
    keys, names = ["kind", "parent"], ("reference", "prediction")
    counted = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    large = written(counted(gold, "n").join(counted(pred, "m"), keys).filter(F.col("n") * F.col("m") > PAIRS).select(*keys), "large-parents")
    some = not large.isEmpty()
    few = [df.join(large, keys, "left_anti") if some else df for df in (gold, pred)]

    seen = [d for d, *_ in NARROWING if d not in keys]
    other = few[1].select(*keys, F.col("id").alias("o_id"), *[F.col(d).alias(f"o_{d}") for d in seen])
    test = lambda d: F.col(d) == F.col(f"o_{d}") if d in EXACT else F.coalesce(F.col(d) == F.col(f"o_{d}"), F.lit(True))
    agree, tests = F.lit(True), []
    for d, *_ in NARROWING:
        agree = agree if d in keys else agree & F.coalesce(test(d), F.lit(False))
        tests.append(agree)
    met = few[0].join(other, keys).select("id", "o_id", *[x.alias(f"ok{k}") for k, x in enumerate(tests)])
    last = f"ok{len(tests) - 1}"
    met = written(met, "pairs")
    degrees, reasons = [], []
    for which, (own, theirs) in enumerate((("id", "o_id"), ("o_id", "id"))):
        found = met.groupBy(F.col(own).alias("id")).agg(
            F.count_if(last).alias("degree"), F.min(F.when(F.col(last), F.col(theirs))).alias("partner"), *[F.bool_or(f"ok{k}").alias(f"some{k}") for k in range(len(tests))]
        )
        degrees.append(found.filter("degree > 0").select("id", "degree", "partner"))
        reason: Column = F.lit(None).cast("string")
        for k in range(len(tests) - 1, -1, -1):
            reason = F.when(~F.coalesce(f"some{k}", F.lit(False)), NARROWING[k][1 + which]).otherwise(reason)
        reasons.append(few[which].select("id").join(found, "id", "left").select("id", reason.alias("reason")))
    if some:
        many = [df.join(large, keys, "left_semi") for df in (gold, pred)]
        more = candidates(*many, list(EXACT), list(LOOSE)), candidates(*many[::-1], list(EXACT), list(LOOSE), flip=True)
        degrees = [a.unionByName(b) for a, b in zip(degrees, more, strict=True)]
        reasons = [a.unionByName(_narrowed(many[w], many[1 - w], names[w])) for w, a in enumerate(reasons)]
    return dict(zip(names, (_marked(*degrees), _marked(*degrees[::-1])), strict=True)), dict(zip(names, reasons, strict=True))


def _narrowed(rows: DataFrame, others: DataFrame, side: str) -> DataFrame:
    """(id, reason): the first dimension that leaves a row without candidates, if one does."""
    left = rows.select("id")
    reason: Column = F.lit(None).cast("string")
    for k in range(len(NARROWING), 0, -1):
        used = [d for d, *_ in NARROWING[:k]]
        exact, loose = ["kind", *[d for d in used if d in EXACT]], [d for d in used if d in LOOSE]
        some = candidates(rows, others, exact, loose, flip=side == "prediction").select("id", F.lit(True).alias(f"some{k}"))
        left = left.join(some, "id", "left")
        told = NARROWING[k - 1][1 if side == "reference" else 2]
        reason = F.when(F.col(f"some{k}").isNull(), told).otherwise(reason)
    return left.select("id", reason.alias("reason"))
