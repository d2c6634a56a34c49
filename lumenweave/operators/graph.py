"""Graphs as edge tables: connected components, bounded search, matchings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.shared import drop_path, written


#: Edges that a task puts together before it sends on what they connect.
CONTRACTED = 1 << 18


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v): every node with another, or itself, that it is connected with: a forest of each task's edges."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        above: dict = {}

        def root(x):
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        def flush(schema):
            nodes = list(above)
            return pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array([root(x) for x in nodes], schema.field(0).type)], names=["u", "v"])

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                above.setdefault(a, a)
                above.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
            if len(above) >= CONTRACTED:
                yield flush(schema)
                above.clear()
        if above:
            yield flush(schema)

    return edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL").mapInArrow(run, f"u {kind}, v {kind}")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's larger neighbours, or else its smaller ones and itself, connected with the least of them."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.filter("v <= u") if small else both
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = (near if small else both.filter("v > u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); the component is its least node.  Edges with a null end are none.

    Tasks first put together what their own edges connect, so that one edge a node goes on.  Then each round connects
    a node's larger neighbours and then its smaller ones with the least of them, until every component is a star: one
    join and two aggregates a step, neighbours never gathered, and the edges written out each round.
    """
    first = written(_contracted(edges), "edges")
    stars, mark = written(first.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars"), None
    while True:
        row = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            break
        mark, again = (row["n"], row["h"]), written(_star(_star(stars, small=False), small=True), "stars")
        drop_path(edges.sparkSession, stars)
        stars = again
    # In stars every node but its component's least has one edge, which leads there.
    nodes = first.select(F.col("u").alias("node")).distinct()
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_shapes(edges: DataFrame) -> DataFrame:
    """Bipartite ``edges`` (gold, pred) judged by their component's shape: gold, pred, status.

    MATCHED is one to one, SPLIT one gold entity to several, MERGED several to
    one; everything else is AMBIGUOUS.  Sides are told apart by name prefixes.
    """
    named = edges.select("gold", "pred", F.concat(F.lit("g:"), "gold").alias("u"), F.concat(F.lit("p:"), "pred").alias("v"))
    found = components(named)
    sizes = found.groupBy("component").agg(F.count_if(F.col("node").startswith("g:")).alias("n_gold"), F.count_if(F.col("node").startswith("p:")).alias("n_pred"))
    status = (
        F.when((F.col("n_gold") == 1) & (F.col("n_pred") == 1), "MATCHED").when(F.col("n_gold") == 1, "SPLIT").when(F.col("n_pred") == 1, "MERGED").otherwise("AMBIGUOUS")
    )
    placed = named.join(found, F.col("u") == F.col("node")).join(sizes, "component")
    return placed.select("gold", "pred", status.alias("status"))


def bounded_search(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) of what lies within ``max_depth`` steps of ``starts`` (node) along directed ``edges`` (u, v)."""
    seen = written(starts.select("node").distinct().withColumn("depth", F.lit(0)), "reached")
    for depth in range(1, max_depth + 1):
        step = edges.join(seen.filter(F.col("depth") == depth - 1), F.col("u") == F.col("node")).select(F.col("v").alias("node")).distinct()
        fresh = step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        seen = written(seen.union(fresh), "reached")
    return seen


def perfect_matching(edges: DataFrame, group: str, sizes: DataFrame) -> DataFrame:
    """Whether each group's left and right elements can be paired off along ``edges`` (group, left, right).

    ``sizes`` has group, n_left and n_right.  Augmenting paths, one group at a
    time: a group is one field's few conflicting candidates.
    """

    def kuhn(batches):
        for batch in batches:
            paired = []
            for left, right in zip(batch.column("_left").to_pylist(), batch.column("_right").to_pylist(), strict=True):
                near: dict = {}
                for x, y in zip(left or (), right or (), strict=True):
                    near.setdefault(x, []).append(y)
                taken: dict = {}

                def place(x, tried, near=near, taken=taken) -> bool:
                    for y in near[x]:
                        if y not in tried:
                            tried.add(y)
                            if y not in taken or place(taken[y], tried):
                                taken[y] = x
                                return True
                    return False

                paired.append(sum(place(x, set()) for x in sorted(near)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paired, pa.int64()), batch.column("n_left"), batch.column("n_right")], names=[group, "paired", "n_left", "n_right"])

    kind = dict(sizes.dtypes)
    # A row a group, many in a batch: with a call for each group the calls would cost the most.
    whole = edges.filter("left IS NOT NULL AND right IS NOT NULL").groupBy(group).agg(F.collect_list("left").alias("_left"), F.collect_list("right").alias("_right"))
    met = sizes.select(group, "n_left", "n_right").join(whole, group, "left")
    done = met.mapInArrow(kuhn, f"{group} {kind[group]}, paired long, n_left {kind['n_left']}, n_right {kind['n_right']}")
    return done.select(group, "paired", ((F.col("n_left") == F.col("n_right")) & (F.col("n_left") == F.col("paired"))).alias("perfect"))
