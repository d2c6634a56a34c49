"""Mixing sources to target weights by weighted fair queueing (native).

Every source is a flow whose documents are queued in a seeded shuffle, once per
repeat.  A queued copy's virtual finish time is the flow's cumulative tokens up
to and including it, divided by the flow's target.  All copies are then ordered
by finish time and taken while the running total stays within the budget.

Nothing is ordered in one task.  A source's cumulative tokens come from blocks
of the shuffle key: totals per block, their running sums, and a window inside
each block.  The global cut comes from two rounds of pre-aggregated histograms
of the finish time; only copies of one fine bin are compared one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Hex digits of the shuffle key that name a block: 4096 blocks a source.
BLOCK_DIGITS = 3
#: Bins a unit of virtual time in each of the two rounds, and units kept apart.
BINS, UNITS = 1024, 4


@dataclass(frozen=True)
class MixSpec:
    """``weights`` repeat over the sources in code-point order, null last."""

    weights: tuple[int, ...] = (5, 2, 1)
    budget: float = 1.5
    max_repeats: int = 2
    seed: str = "mix"


def source_targets(sized: DataFrame, spec: MixSpec) -> DataFrame:
    """source, source_size, weight, target: weighted shares of the budget, none above the cap.

    The level is where ``sum(min(cap, level * weight))`` meets the budget; with
    sources in order of ``cap / weight`` it is the first for which sharing what
    is left among it and all later ones stays within its own cap.  Works on one
    pre-aggregated row a source.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in spec.weights])
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    ranked = (
        per_source.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.get(weights, (F.col("rank") - 1) % len(spec.weights)))
        .withColumn("cap", F.col("source_size") * float(spec.max_repeats))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(spec.budget)))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    )
    share = F.col("level") * F.col("weight")
    target = F.when(F.col("level").isNull() | (share > F.col("cap")), F.col("cap")).otherwise(share)
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _queued(sized: DataFrame, targets: DataFrame, spec: MixSpec, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document with ``cum``, its source's words up to and including it."""
    keyed = sized.withColumn("key", F.md5(F.concat(F.lit(f"{spec.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("nameless")))))
    keyed = keyed.withColumn("block", F.substring("key", 1, BLOCK_DIGITS))
    by_block = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
        .withColumn("offset", F.coalesce(F.sum("block_size").over(by_block), F.lit(0)))
        .select(F.col("source").alias("o_source"), F.col("block").alias("o_block"), "offset")
    )
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0)
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    return (
        keyed.withColumn("cum", F.sum("size").over(inside))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("block") == F.col("o_block")))
        .join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("cum", F.col("cum") + F.col("offset"))
        .select("doc_id", "source", "size", "key", "source_size", "target", "cum", *carry)
    )


def mix(docs: DataFrame, spec: MixSpec = MixSpec(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, copies, taken.

    One row per input row.  Null and empty texts have size 0, are taken and add
    nothing; a null source is a source of its own, ordered last; a null id is
    shuffled by its text's hash.  Repeated rows are queued one after the
    other, so each counts.  An empty table gives an empty result.  Columns in
    ``carry`` come along, and order what id and size do not.
    """
    nameless = F.when(F.col(id_col).isNull(), F.xxhash64(text_col).cast("string"))
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), nameless.alias("nameless"), *carry), "mix-sizes")
    targets = materialize(source_targets(sized, spec), "mix-targets")
    queued = materialize(_queued(sized, targets, spec, carry), "mix-queue")
    budget = (targets.agg(F.sum("source_size")).first()[0] or 0) * spec.budget
    epochs = F.explode(F.sequence(F.lit(0), F.lit(spec.max_repeats - 1)))
    copies = queued.withColumn("epoch", epochs).withColumn("finish", F.coalesce(F.try_divide((F.col("epoch") * F.col("source_size") + F.col("cum")).cast("double"), F.col("target")), F.lit(0.0)))

    def cut(rows: DataFrame, bin_of, room: float) -> tuple[int | None, float]:
        """The first bin in which the running total passes ``room``, and the room left before it."""
        bins = rows.groupBy(bin_of.alias("bin")).agg(F.sum("size").alias("n"))
        running = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        found = bins.withColumn("total", F.sum("n").over(running)).filter(F.col("total") > room).orderBy("bin").first()
        return (None, 0.0) if found is None else (found["bin"], room - (found["total"] - found["n"]))

    coarse = F.least(F.floor(F.col("finish") * BINS), F.lit(BINS * UNITS)).cast("long")
    fine = F.least(F.floor((F.col("finish") * BINS - coarse) * BINS), F.lit(BINS * BINS)).cast("long")
    first, room = cut(copies, coarse, budget)
    before_cut = F.lit(True)
    if first is not None:
        second, room = cut(copies.filter(coarse == first), fine, room)
        in_order = [F.col("finish"), F.col("source").asc_nulls_last()]
        running = Window.partitionBy(F.lit(0)).orderBy(*in_order, "key", "doc_id", "epoch", "size").rowsBetween(Window.unboundedPreceding, 0)
        edge = copies.filter((coarse == first) & (fine == second)).withColumn("total", F.sum("size").over(running))
        stop = edge.filter(F.col("total") > room).orderBy(*in_order).select("finish", "source").first()
        earlier_source = F.col("source").isNotNull() if stop["source"] is None else F.coalesce(F.col("source") < F.lit(stop["source"]), F.lit(False))
        before_cut = (F.col("finish") < stop["finish"]) | ((F.col("finish") == stop["finish"]) & earlier_source)
    finish = lambda e: F.coalesce(F.try_divide((F.lit(e) * F.col("source_size") + F.col("cum")).cast("double"), F.col("target")), F.lit(0.0))
    out = queued.withColumn("copies", F.lit(0))
    for e in range(spec.max_repeats):
        out = out.withColumn("finish", finish(e)).withColumn("copies", F.col("copies") + before_cut.cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *carry)
