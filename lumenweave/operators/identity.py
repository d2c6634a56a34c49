"""Identity by several dimensions at once: three- and four-valued comparison, complete-link grouping, reciprocity."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def three_valued(*dimensions: Column) -> Column:
    """False if any dimension is false, else null if any is unknown, else true."""
    some = lambda ok: sum((F.when(ok(d), 1).otherwise(0) for d in dimensions), F.lit(0)) > 0
    return F.when(some(lambda d: ~F.coalesce(d, F.lit(True))), False).when(some(lambda d: d.isNull()), None).otherwise(True)


def dimension(a: Column, b: Column) -> Column:
    """EXACT, UNKNOWN (either side missing) or CONTRADICTORY."""
    return F.when(a.isNull() | b.isNull(), "UNKNOWN").when(a == b, "EXACT").otherwise("CONTRADICTORY")


def compatibility(*states: Column) -> Column:
    """struct(viable, safe): viable without a contradiction, safe if nothing is unknown either."""
    all_of = lambda test: sum((F.when(test(s), 0).otherwise(1) for s in states), F.lit(0)) == 0
    return F.struct(all_of(lambda s: s != "CONTRADICTORY").alias("viable"), all_of(lambda s: s.isin("EXACT", "COMPATIBLE")).alias("safe"))


def reciprocal(fields: DataFrame, targets: DataFrame, field_key: str, evidence: str) -> DataFrame:
    """(field_key, grounded): every piece of evidence that a field names exists and points back, and there is one at least.

    ``fields`` has field_key and an array of evidence ids; ``targets`` has evidence and the field_key it points to.
    """
    named = fields.select(field_key, F.explode_outer(evidence).alias("_e"))
    back = targets.select(F.col(evidence).alias("_e"), field_key).distinct().withColumn("_back", F.lit(True))
    met = named.join(back, ["_e", field_key], "left")
    return met.groupBy(field_key).agg(F.bool_and(F.col("_e").isNotNull() & F.col("_back").isNotNull()).alias("grounded"))


def complete_link(pairs: DataFrame, nodes: DataFrame, block: str, node: str) -> DataFrame:
    """(block, node, group): greedy in node order, a node joins the first group all of whose members it may be with.

    ``pairs`` (block, a, b) are those allowed; being allowed is not transitive,
    so groups are no components.  Blocks are one study's few outcomes.
    """

    kinds = dict(nodes.dtypes)
    packed = (
        nodes.groupBy(block).agg(F.collect_set(node).alias("_nodes"))
        .join(pairs.groupBy(block).agg(F.collect_list("a").alias("_a"), F.collect_list("b").alias("_b")), block, "left")
    )

    def link(batches):
        for batch in batches:
            sizes, at, out = [], [], []
            nodes_, a, b = (batch.column(c).to_pylist() for c in ("_nodes", "_a", "_b"))
            for i, own in enumerate(nodes_):
                near: dict = {}
                for x, y in zip(a[i] or (), b[i] or (), strict=True):
                    near.setdefault(x, set()).add(y)
                    near.setdefault(y, set()).add(x)
                groups: list[list] = []
                for n in sorted(own):
                    mine = near.get(n, ())
                    k = next((k for k, g in enumerate(groups) if all(m in mine for m in g)), len(groups))
                    groups[k:] = [[*groups[k], n], *groups[k + 1 :]] if k < len(groups) else [[n]]
                    at.append(n)
                    out.append(k + 1)
                sizes.append(len(own))
            which = pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int64())
            kind = batch.schema.field("_nodes").type.value_type
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), pa.array(at, kind), pa.array(out, pa.int32())], names=[block, node, "group"])

    return packed.select(block, "_nodes", "_a", "_b").mapInArrow(link, f"{block} {kinds[block]}, {node} {kinds[node]}, group int")


def bind_all(labels: DataFrame, aliases: DataFrame, key: str, label: str, owner: str) -> DataFrame:
    """(key, owner): bound only if every label of a key has one owner and it is the same."""
    owners = aliases.groupBy(label).agg(F.min(owner).alias(owner), F.countDistinct(owner).alias("_n"))
    met = labels.join(owners, label, "left")
    bound = (F.count_if(F.coalesce(F.col("_n") != 1, F.lit(True))) == 0) & (F.countDistinct(owner) == 1)
    return met.groupBy(key).agg(F.when(bound, F.min(owner)).alias(owner))
