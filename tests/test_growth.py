"""Queries whose cost must grow with their rows: how their plans and expressions do the work."""

import pytest
from pyspark.sql import functions as F

from lumenweave.operators import documents, grids, linking
from lumenweave.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["gr03_complete_link", "jn13_gr05_perfect_matching"])
def test_small_groups_are_looped_over_in_batches(spark, name):
    """A call of Python for each order takes longer than the order."""
    found = plan(QUERIES[name](spark, SF))
    assert "MapInArrow" in found and "FlatMapGroups" not in found


@pytest.mark.parametrize("name", ["wn10_pf15_header_paths", "nm11_column_values", "aj10_payload_records"])
def test_rows_of_small_files_are_spread_before_slow_work(spark, name):
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SF))


def test_a_grid_is_made_once_for_all_its_columns(spark):
    """As often as it stands in the expression, and more often within a function, it would be worked out."""
    grid = F.transform(F.col("g"), lambda r: F.transform(r, lambda x: F.concat(F.lit("made "), x)))
    rows = spark.createDataFrame([([["a", "b", "b"], ["a", "", "c"]],)], "g array<array<string>>").select(grids.header_paths(grid).alias("p"))
    assert rows.first()["p"] == [["made a"], ["made b", "made "], ["made b", "made c"]]
    analyzed = rows._jdf.queryExecution().optimizedPlan().toString()
    assert analyzed.count("made ") == 1


def test_results_of_few_are_not_multiplied_by_patterns(spark, monkeypatch):
    """Orders have few lines: no row is exploded; by pairs and by counts the results are the same."""
    found = QUERIES["jn07_seven_dimensions"](spark, SF)
    assert "Generate explode" not in plan(found)
    by_pairs = set(found.collect())
    for pairs in (0, 4):
        monkeypatch.setattr(linking, "PAIRS", pairs)
        assert set(QUERIES["jn07_seven_dimensions"](spark, SF).collect()) == by_pairs


def test_tables_of_a_page_are_found_in_its_row(spark):
    """No sort or window holds the tables of many pages in one task."""
    found = plan(QUERIES["sc22_html_tables_once"](spark, SF))
    assert "Window" not in found and "Sort " not in found and "REPARTITION_BY_NUM" in found
    one = lambda *cells: "<table>" + "".join(f"<tr><td>{c}</td></tr>" for c in cells) + "</table>"
    pages = [(1, one("b") + one("a") + one("B") + one("a", "b") + one("A") + "<table></table>" + one() + one("c")), (2, "none"), (3, ""), (4, None), (5, one("a"))]
    got = documents.html_tables(spark.createDataFrame(pages, "id int, html string").coalesce(1), "id", "html")
    assert sorted((r.id, r.table_id, r.header, r.rows) for r in got.collect()) == [
        (1, "table-1", None, [["b"]]), (1, "table-2", None, [["a"]]), (1, "table-3", None, [["a"], ["b"]]), (1, "table-4", None, []), (1, "table-5", None, [["c"]]), (5, "table-1", None, [["a"]]),
    ]
