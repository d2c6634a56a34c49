"""Header grids and values of columns, without leaving the JVM.

Rows of a header are folded from top to bottom.  What a cell with a row span
leaves for the rows below it is carried along as a short list; a row takes from
it what stands before each of its own cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions import numbers
from lumenweave.functions.text import collapse

_ACTIVE = "array<struct<col:int,cell:string,left:int>>"
_CELLS = "array<struct<col:int,cell:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)``, the value worked out once: the array has one element."""
    return F.get(F.transform(F.array(value), use), 0)


def _inside(x: Column, low: Column, high: Column) -> Column:
    return (x["col"] >= low) & (x["col"] < high)


def _consumed(s: Column) -> Column:
    """State (col, cells, active) after taking over the active cells that stand at ``col`` and right after it."""
    ahead = F.sequence(s["col"], s["col"] + F.size(s["active"]))
    free = F.array_min(F.filter(ahead, lambda c: ~F.exists(s["active"], lambda a: a["col"] == c)))

    def move(end: Column) -> Column:
        taken = F.filter(s["active"], lambda a: _inside(a, s["col"], end))
        kept = F.filter(s["active"], lambda a: ~_inside(a, s["col"], end))
        below = F.transform(F.filter(taken, lambda a: a["left"] > 1), lambda a: F.struct(a["col"], a["cell"], (a["left"] - 1).alias("left")))
        return F.struct(end.alias("col"), F.concat(s["cells"], F.transform(taken, lambda a: F.struct(a["col"], a["cell"]))).alias("cells"), F.concat(kept, below).alias("active"))

    return _let(free, move)


def _placed(s: Column, x: Column) -> Column:
    """State after a cell of its own at ``col``, over as many columns as it spans."""
    end = s["col"] + F.greatest(F.lit(1), x["colspan"])
    columns = F.sequence(s["col"], end - 1)
    outside = lambda name: F.filter(s[name], lambda a: ~_inside(a, s["col"], end))
    own = F.transform(columns, lambda c: F.struct(c.alias("col"), x["cell"].alias("cell")))
    below = F.transform(columns, lambda c: F.struct(c.alias("col"), x["cell"].alias("cell"), (x["rowspan"] - 1).alias("left")))
    return F.struct(end.alias("col"), F.concat(outside("cells"), own).alias("cells"), F.when(x["rowspan"] > 1, F.concat(outside("active"), below)).otherwise(s["active"]).alias("active"))


def header_grid(rows: Column) -> Column:
    """array<array<string>>: every header row over all columns, spans filled in, all rows equally wide.

    ``rows`` is an array of rows, each an array of struct(cell, rowspan, colspan).  A spanned cell stands in each of its
    rows; places that nothing reaches are empty.
    """
    start = F.struct(F.array().cast(_ACTIVE).alias("active"), F.array().cast("array<array<struct<col:int,cell:string>>>").alias("grid"))

    def row(acc: Column, specs: Column) -> Column:
        first = F.struct(F.lit(0).alias("col"), F.array().cast(_CELLS).alias("cells"), acc["active"].alias("active"))
        done = F.aggregate(specs, first, lambda s, x: _let(_consumed(s), lambda c: _placed(c, x)), _consumed)

        def close(s: Column) -> Column:
            # What is still active further right stands in this row too, and goes on.
            beyond = F.filter(s["active"], lambda a: ~F.exists(s["cells"], lambda c: c["col"] == a["col"]))
            cells = F.concat(s["cells"], F.transform(beyond, lambda a: F.struct(a["col"], a["cell"])))
            return F.struct(s["active"].alias("active"), F.array_append(acc["grid"], cells).alias("grid"))

        return _let(done, close)

    def squared(acc: Column) -> Column:
        width = F.coalesce(F.array_max(F.flatten(F.transform(acc["grid"], lambda r: F.transform(r, lambda c: c["col"])))), F.lit(-1))
        at = lambda r, c: F.coalesce(F.get(F.transform(F.filter(r, lambda x: x["col"] == c), lambda x: x["cell"]), 0), F.lit(""))
        columns = F.when(width >= 0, F.sequence(F.lit(0), width)).otherwise(F.array().cast("array<int>"))
        return _let(columns, lambda known: F.transform(acc["grid"], lambda r: F.transform(known, lambda c: at(r, c))))

    return F.aggregate(rows, start, row, squared)


def header_paths(grid: Column) -> Column:
    """array<array<string>>: each column's texts from top to bottom, empty ones left out, one that goes on below once."""

    def of(grid: Column) -> Column:
        width = F.coalesce(F.size(F.get(grid, 0)), F.lit(0))

        def path(c: Column) -> Column:
            texts = F.filter(F.transform(grid, lambda r: F.get(r, c)), lambda x: F.coalesce(x, F.lit("")) != "")
            return _let(texts, lambda t: F.filter(t, lambda x, i: (i == 0) | (x != F.coalesce(F.get(t, i - 1), F.lit("")))))

        return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), path)).otherwise(F.array().cast("array<array<string>>"))

    # Worked out once: as an expression, the grid would be made again for each column.
    return _let(grid, of)


def _dashes(cell: Column) -> Column:
    return F.translate(cell, "−–", "--")


def _whole(cell: Column) -> Column:
    value = numbers.strict_number(_dashes(cell))["value"]
    return F.when((value >= 0) & (value == F.floor(value)), value.cast("long"))


#: Which statistics fill which fields of an arm.  Every field is filled from its first column that gives a value.
FILLS = (
    (("mean_sd", "mean_or_median"), {"estimate": lambda c: numbers.mean_sd(_dashes(c))["mean"], "value": lambda c: numbers.mean_sd(_dashes(c))["mean"], "sd": lambda c: F.abs(numbers.mean_sd(_dashes(c))["sd"])}),
    (("value", "effect"), {"estimate": lambda c: numbers.strict_number(_dashes(c))["value"], "value": lambda c: numbers.strict_number(_dashes(c))["value"]}),
    (("n",), {"n": _whole}),
    (("confidence_interval",), {"lower": lambda c: numbers.interval(_dashes(c))["lower"], "upper": lambda c: numbers.interval(_dashes(c))["upper"]}),
)
FIELDS = {"estimate": "double", "value": "double", "sd": "double", "n": "long", "lower": "double", "upper": "double"}


def arm_key(label: Column) -> Column:
    """A label as arms are matched; null for none and for NR."""
    plain = F.lower(collapse(label))
    return F.when(~plain.isin("", "nr"), plain)


def projected(cells: DataFrame, columns: DataFrame, arms: DataFrame, table: str = "table", row: str = "row") -> DataFrame:
    """``arms`` (table, row, arm_label and any of ``FIELDS``), each field that is null filled from the row's cells.

    ``cells``: table, row, col, cell; ``columns``: table, col, arm_label, statistic.  A cell counts for the arm that its
    column names and for the fields of its column's statistic.  Values that are there already stay; cells of columns
    that name no arm, and what cannot be read as its statistic, fill nothing.
    """
    named = columns.select(table, "col", arm_key(F.col("arm_label")).alias("_arm"), "statistic").filter("_arm IS NOT NULL")
    met = cells.select(table, row, "col", "cell").join(named, [table, "col"])

    def first(field: str) -> Column:
        reads = [F.when(F.col("statistic").isin(*kinds), fields[field](F.col("cell"))) for kinds, fields in FILLS if field in fields]
        value = F.coalesce(*reads)
        return F.min_by(value, F.when(value.isNotNull(), F.col("col"))).cast(FIELDS[field]).alias(f"_{field}")

    found = met.groupBy(table, row, "_arm").agg(*[first(f) for f in FIELDS])
    joined = arms.withColumn("_arm", arm_key(F.col("arm_label"))).join(found, [table, row, "_arm"], "left")
    own = lambda f: F.coalesce(F.col(f).cast(FIELDS[f]), f"_{f}") if f in arms.columns else F.col(f"_{f}")
    return joined.select(*[c for c in arms.columns if c not in FIELDS], *[own(f).alias(f) for f in FIELDS])


def p_cells(cells: DataFrame, columns: DataFrame, table: str = "table", row: str = "row") -> DataFrame:
    """(table, row, col, raw_value, value, comparator) of the cells under a column of P values."""
    met = cells.join(columns.filter("statistic = 'p_value'").select(table, "col"), [table, "col"])
    told = met.withColumn("p", numbers.p_value(F.col("cell")))
    return told.select(table, row, "col", F.col("cell").alias("raw_value"), F.col("p.value").alias("value"), F.col("p.operator").alias("comparator"))
