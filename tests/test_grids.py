"""Header grids against a plain walk over rows; values by column."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenweave.operators import grids

SPECS = "id long, rows array<array<struct<cell:string,rowspan:int,colspan:int>>>"


def brute(rows):
    """By columns that spans are still active in, as text and rows left."""
    active, out = {}, []
    for specs in rows:
        cells, col = {}, 0

        def take():
            nonlocal col
            while col in active:
                text, left = active.pop(col)
                cells[col] = text
                if left > 1:
                    later[col] = (text, left - 1)
                col += 1

        later = {}
        for text, down, across in specs:
            take()
            for c in range(col, col + max(1, across)):
                cells[c] = text
                if down > 1:
                    active.pop(c, None)
                    later[c] = (text, down - 1)
            col += max(1, across)
        take()
        out.append(cells | {c: v[0] for c, v in active.items() if c not in cells})
        active |= later
    width = max((max(r, default=-1) for r in out), default=-1) + 1
    return [[r.get(c, "") for c in range(width)] for r in out]


ROWS = st.lists(st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(1, 3), st.integers(0, 3)), max_size=4), max_size=4)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROWS, min_size=40, max_size=40))
def test_grid(spark, tables):
    # A wide cell may not run into an active one: HTML leaves what happens then open.
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], SPECS).repartition(4)
    got = {r.id: r.grid for r in df.select("id", grids.header_grid(F.col("rows")).alias("grid")).collect()}
    for i, t in enumerate(tables):
        assert clashes(t) or got[i] == brute(t), t


def clashes(rows):
    active = {}
    for specs in rows:
        col, later = 0, {}
        for _, down, across in specs:
            while col in active:
                col += 1
            for c in range(col, col + max(1, across)):
                if c in active:
                    return True
                if down > 1:
                    later[c] = down
            col += max(1, across)
        active = {c: n - 1 for c, n in active.items() if n > 1} | {c: n - 1 for c, n in later.items()}
    return False


def test_known_header(spark):
    rows = [[("Outcome", 2, 1), ("Drug", 1, 2), ("P", 3, 1)], [("n", 1, 1), ("Mean", 2, 1)], [("at 6 weeks", 1, 1), ("N", 1, 1)]]
    df = spark.createDataFrame([(1, rows), (2, []), (3, [[]])], SPECS)
    got = {r.id: (r.g, r.p) for r in df.select("id", grids.header_grid(F.col("rows")).alias("g")).select("id", "g", grids.header_paths(F.col("g")).alias("p")).collect()}
    assert got[1][0] == [["Outcome", "Drug", "Drug", "P"], ["Outcome", "n", "Mean", "P"], ["at 6 weeks", "N", "Mean", "P"]]
    assert got[1][1] == [["Outcome", "at 6 weeks"], ["Drug", "n", "N"], ["Drug", "Mean"], ["P"]]
    assert got[2] == ([], []) and got[3] == ([[]], [])


def test_values_fill_only_what_is_null(spark):
    cells = spark.createDataFrame([(1, 0, c, v) for c, v in enumerate(["Pain", "12", "1.8 (−0.7)", "n/a", "3.5", "0.1 to 0.9", "p = 0.03"])], "table long, row int, col int, cell string")
    columns = spark.createDataFrame([(1, 0, "NR", "value"), (1, 1, "Drug  A", "n"), (1, 2, "drug a", "mean_sd"), (1, 3, "Drug A", "value"), (1, 4, "Drug A", "value"), (1, 5, "Drug A", "confidence_interval"), (1, 6, "", "p_value")], "table long, col int, arm_label string, statistic string")
    arms = spark.createDataFrame([(1, 0, " DRUG a", None, 5.0), (1, 0, "Other", 1.0, None), (2, 0, "Drug A", None, None)], "table long, row int, arm_label string, estimate double, lower double")
    got = {(r.table, r.arm_label): (r.estimate, r.value, r.sd, r.n, r.lower, r.upper) for r in grids.projected(cells, columns, arms).collect()}
    assert got == {(1, " DRUG a"): (1.8, 1.8, 0.7, 12, 5.0, 0.9), (1, "Other"): (1.0, None, None, None, None, None), (2, "Drug A"): (None,) * 6}
    assert [tuple(r) for r in grids.p_cells(cells, columns).collect()] == [(1, 0, 6, "p = 0.03", 0.03, "=")]


def test_no_python_worker(spark):
    df = spark.createDataFrame([(1, [[("a", 1, 1)]])], SPECS)
    plan = df.select(grids.header_paths(grids.header_grid(F.col("rows"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
