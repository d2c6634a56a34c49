"""Table topology: header paths of columns, arms named in headers, rows found again by their quotes, text around tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.labels import header_arm, header_time
from lumenweave.functions.text import clean_cell, collapse, strip

#: How rows are marked in a rendered context: [ROW 3] a | b ROW_ID=x
MARKED = r"(?i)\[ROW\s+[0-9]+\]\s*(.*?)\s+ROW_ID=(\S+)\s*$"


def cell_specs(row: Column) -> Column:
    """array<struct<cell, rowspan, colspan>> of an HTML row, or of a row of pipes, where ``\\|`` is a bar within a cell."""
    tags = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>.*?</t[dh]>"), F.lit(0))
    span = lambda x, name: F.greatest(F.lit(1), F.coalesce(F.regexp_extract(x, rf'(?is)^<t[dh][^>]*\b{name}\s*=\s*["\']?([0-9]+)', 1).try_cast("int"), F.lit(1)))
    html = F.transform(tags, lambda x: F.struct(clean_cell(x).alias("cell"), span(x, "rowspan").alias("rowspan"), span(x, "colspan").alias("colspan")))
    bare = F.regexp_replace(strip(row), r"^\||(?<!\\)\|$", "")
    piped = F.transform(F.split(bare, r"(?<!\\)\|"), lambda x: F.struct(collapse(F.replace(x, F.lit("\\|"), F.lit("|"))).alias("cell"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan")))
    return F.when(row.contains("<t"), html).otherwise(piped)


def column_map(header_cells: DataFrame, table: str = "table") -> DataFrame:
    """(table, col, path, arm, time): each column's header texts from top to bottom, repeats in a row once, and what they name.

    ``header_cells`` has table, row, col and cell, spans filled in.
    """
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("row", "cell"))), lambda x: x["cell"]), lambda x: F.trim(x) != "")
    path = F.filter(F.col("texts"), lambda x, i: (i == 0) | (x != F.coalesce(F.get("texts", i - 1), F.lit(""))))
    out = header_cells.groupBy(table, "col").agg(texts.alias("texts")).withColumn("path", path)
    return out.select(table, "col", "path", header_arm(F.col("path")).alias("arm"), header_time(F.array_join("path", " ")).alias("time"))


def arm_registry(header_cells: DataFrame, table: str = "table") -> DataFrame:
    """(table, arm, n): arms that header cells name with their size, as "name (n = 12)", once each."""
    pattern = r"(?i)^(.*?)\s*\(?\s*n\s*=\s*([0-9]+)\s*\)?\s*$"
    found = header_cells.filter(F.col("cell").rlike(pattern)).select(table, collapse(F.regexp_extract("cell", pattern, 1)).alias("arm"), F.regexp_extract("cell", pattern, 2).cast("int").alias("n"))
    return found.filter("arm <> ''").distinct()


def headed_by_first_row(tables: DataFrame) -> DataFrame:
    """``tables`` (header, rows) with the first row as header where there is none and it names two arms at least."""
    first = F.get("rows", 0)
    names = F.size(F.filter(first, lambda x: header_arm(F.array(x)) != "NR"))
    move = F.col("header").isNull() & (F.coalesce(names, F.lit(0)) >= 2)
    return tables.withColumns({"header": F.when(move, first).otherwise(F.col("header")), "rows": F.when(move, F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows"))})


def marked_rows(contexts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, row_id, quote): the marked rows of rendered contexts."""
    lines = contexts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content")).filter(F.col("content").rlike(MARKED))
    return lines.select(key, "line", F.regexp_extract("content", MARKED, 2).alias("row_id"), collapse(F.regexp_extract("content", MARKED, 1)).alias("quote"))


def recover_row_ids(quotes: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``quotes`` (id, key, quote) with row_id: of the first marked row that holds the quote or is held by it, else as the quote says, else NR."""
    a, b = F.lower(collapse(F.col("quote"))), F.lower(F.col("_row"))
    met = quotes.join(rows.select(key, F.col("line").alias("_line"), F.col("row_id").alias("_id"), F.col("quote").alias("_row")), key).filter((a != "") & (F.contains(b, a) | F.contains(a, b)))
    first = met.groupBy("id").agg(F.min_by("_id", "_line").alias("_found"))
    said = F.nullif(F.regexp_extract("quote", r"(?i)ROW_ID\s*[=:]\s*([^\s,;]+)", 1), F.lit(""))
    return quotes.join(first, "id", "left").withColumn("row_id", F.when(a == "", "NR").otherwise(F.coalesce("_found", said, F.lit("NR")))).drop("_found")


def row_quotes(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``wanted`` (key, row_id) with the quote of the first row of that id, part suffixes aside; empty where there is none."""
    plain = lambda c: strip(F.regexp_replace(c, "#part-[^:]+", ""))
    first = rows.groupBy(key, plain(F.col("row_id")).alias("_plain")).agg(F.min_by("quote", "line").alias("_quote"))
    joined = wanted.withColumn("_plain", plain(F.col("row_id"))).join(first, [key, "_plain"], "left")
    return joined.withColumn("quote", F.coalesce("_quote", F.lit(""))).drop("_plain", "_quote")


def evidence_units(quotes: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """``quotes`` (id, key, quote) with unit: the first table or paragraph (key, place, unit) that has the quote, white space aside; else null."""
    met = quotes.join(units.select(key, "place", "unit"), key).filter((F.trim("quote") != "") & F.contains(F.lower(collapse(F.col("unit"))), F.lower(collapse(F.col("quote")))))
    return quotes.join(met.groupBy("id").agg(F.min_by("unit", "place").alias("unit")), "id", "left")


def footnotes(lines: DataFrame, key: str) -> DataFrame:
    """(key, run, footnote): the paragraph right after each table; ``lines`` has key, line, kind and content.

    A blank line may stand between; a heading or another table ends the search.
    """
    w = Window.partitionBy(key).orderBy("line")
    filled = lines.filter(F.trim("content") != "")
    after = filled.withColumn("_before", F.lag("kind").over(w)).withColumn("run", F.sum(((F.col("kind") == "table") & (F.coalesce("_before", F.lit("")) != "table")).cast("int")).over(w))
    return after.filter("kind = 'text' AND _before = 'table'").select(key, "run", strip(F.col("content")).alias("footnote"))
