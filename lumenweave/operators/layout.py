"""Page layout: columns, reading order, kinds of blocks, chunks for retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.labels import formulas

#: How headings begin.
HEADING = r"(?i)^(?:abstract|introduction|methods?|results?|discussion|references?)\b"
CAPITALS = r"^[A-Z][A-Z\s\-:&]{2,80}"
#: Share of the page's width that separates columns, and points from the top that belong to the head.
LEFT, RIGHT, GAP, OVERLAP, FULL, HEAD = 0.46, 0.54, 0.18, 0.02, 0.72, 170


def column_counts(blocks: DataFrame, page: list[str]) -> DataFrame:
    """(page, columns): 2 where block centres lie on both sides or leave a wide gap, else 1.  Blocks have x0, x1 and width."""
    centre = (F.col("x0") + F.col("x1")) / 2
    by_centre = Window.partitionBy(*page).orderBy("centre")
    gap = F.lead("centre").over(by_centre) - F.col("centre")
    placed = blocks.withColumn("centre", centre).withColumn("gap", gap).withColumn("at", F.row_number().over(by_centre))
    n, width = F.count("*"), F.max("width")
    sides = (F.count_if(F.col("centre") < F.col("width") * LEFT) >= 3) & (F.count_if(F.col("centre") > F.col("width") * RIGHT) >= 3)
    widest = F.max(F.struct(F.coalesce("gap", F.lit(-1.0)).alias("gap"), "at"))
    apart = (widest["gap"] > width * GAP) & (widest["at"] >= 3) & (n - widest["at"] >= 2)
    return placed.groupBy(*page).agg(F.when((n < 6) | (width <= 0), 1).when(sides | apart, 2).otherwise(1).alias("columns"))


def reading_order(blocks: DataFrame, page: list[str]) -> DataFrame:
    """``blocks`` (x0, y0, x1, width) with ``place`` on their page: head, left column, right column, what spans both further down; or plainly downwards."""
    on_page = Window.partitionBy(*page)
    centre, width = (F.col("x0") + F.col("x1")) / 2, F.col("width")
    left = F.count_if(centre < width * (0.5 + OVERLAP)).over(on_page)
    right = F.count_if(centre >= width * (0.5 - OVERLAP)).over(on_page)
    two = (F.count("*").over(on_page) >= 4) & (left >= 3) & (right >= 3)
    full = (F.col("x1") - F.col("x0")) > width * FULL
    band = F.when(~two, 0).when(full & (F.col("y0") < HEAD), 0).when(full, 3).when(centre < width / 2, 1).otherwise(2)
    keyed = blocks.withColumn("_band", band).withColumn("_y", F.when(two, F.col("y0")).otherwise(F.round("y0", 1))).withColumn("_x", F.when(two, F.col("x0")).otherwise(F.round("x0", 1)))
    return keyed.withColumn("place", F.row_number().over(on_page.orderBy("_band", "_y", "_x"))).drop("_band", "_y", "_x")


def layout_blocks(chunks: DataFrame) -> DataFrame:
    """``chunks`` (source_type, content, bbox) with kind and confidence: tables and figures by their source, headings and formulas by their text."""
    text = F.col("content")
    kind = (
        F.when(F.col("source_type") == "table", "table")
        .when(F.col("source_type").isin("figure", "figure_caption", "vision"), "figure")
        .when(text.rlike(HEADING) | text.rlike(CAPITALS), "heading")
        .when(F.size(formulas(text)) > 0, "formula")
        .otherwise("text")
    )
    return chunks.withColumn("kind", kind).withColumn("confidence", F.when(F.col("bbox").isNotNull(), 0.75).otherwise(0.55))


def retrieval_chunks(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, chunk_id, kind, content): text blocks and tables as one kind of chunk; tables are not taken twice, blank chunks not at all."""
    both = blocks.filter("kind <> 'table'").select("doc", "chunk_id", "kind", "content").unionByName(tables.select("doc", "chunk_id", F.lit("table").alias("kind"), "content"))
    return both.filter(F.trim("content") != "")
