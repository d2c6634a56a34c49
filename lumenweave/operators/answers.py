"""From a question to a cited answer: search, headers of publications, citations, contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import bm25, top_k

#: Characters of a chunk that stand for it where it has no summary.
EXCERPT = 500


def search(docs: DataFrame, query: list[str], limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rank, citation_id, score): the best ``limit`` chunks of a lexical search, ties by id."""
    best = top_k(bm25(docs, query, id_col, text_col), limit, F.col("score").desc(), F.col(id_col))
    return best.select(F.row_number().over(Window.orderBy(F.col("score").desc(), id_col)).alias("rank"), F.col(id_col).cast("string").alias("citation_id"), "score")


def enriched(chunks: DataFrame, publications: DataFrame, key: str) -> DataFrame:
    """``chunks`` (chunk_id, prefix) with the publication's header (doi, header) before their prefix, and a citation id by DOI, else by ``key``."""
    joined = chunks.join(publications.select(key, "doi", "header"), key, "left")
    prefix = F.concat_ws(" | ", "header", F.nullif(F.trim("prefix"), F.lit("")))
    cited = F.concat_ws("/", F.coalesce("doi", F.col(key).cast("string")), F.col("chunk_id").cast("string"))
    return joined.withColumn("prefix", prefix).withColumn("citation_id", cited).drop("doi", "header")


def cited_answer(hits: DataFrame, cited: DataFrame, contradictions: DataFrame, key: str = "query") -> DataFrame:
    """(query, answer, citation_ids, unsupported, contradiction_ids), without a language model.

    ``hits``: query, rank, citation_id, summary, text; the answer has a line a
    hit, with its citation.  ``cited``: query and the citation_id of claims made
    elsewhere, unsupported where no hit has it.  Bounded by the hits of a query.
    """
    line = F.concat(F.coalesce("summary", F.substring("text", 1, EXCERPT)), F.lit(" [cite: "), F.col("citation_id"), F.lit("]"))
    lines = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"), F.array_sort(F.collect_set("citation_id")).alias("citation_ids"))
    claims = cited.groupBy(key).agg(F.collect_set("citation_id").alias("claimed"))
    against = contradictions.filter("status = 'conflict'").groupBy(key).agg(F.array_sort(F.collect_set("contradiction_id")).alias("contradiction_ids"))
    empty = F.array().cast("array<string>")
    joined = lines.join(claims, key, "left").join(against, key, "left")
    return joined.select(
        key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("answer"), "citation_ids",
        F.array_sort(F.array_except(F.coalesce("claimed", empty), F.col("citation_ids"))).alias("unsupported"), F.coalesce("contradiction_ids", empty).alias("contradiction_ids"),
    )


def first_evidence(chunks: DataFrame, found: DataFrame, key: str, start: int = 12) -> DataFrame:
    """(key, value, chunk_id): the first chunk (chunk_id, content) that has a value's first characters, else the document's first chunk."""
    has = F.contains("content", F.substring("value", 1, start))
    best = chunks.join(found.select(key, "value"), key).groupBy(key).agg(F.first("value").alias("value"), F.coalesce(F.min(F.when(has, F.col("chunk_id"))), F.min("chunk_id")).alias("chunk_id"))
    return found.select(key).distinct().join(best, key, "left")


def first_urls(pairs: Column, limit: int = 6) -> Column:
    """Of an array of struct(source, url), the first of each url, at most ``limit``; blank urls go."""
    filled = F.filter(pairs, lambda x: F.coalesce(F.trim(x["url"]), F.lit("")) != "")
    urls = F.transform(filled, lambda x: x["url"])
    return F.slice(F.filter(filled, lambda x, i: F.array_position(urls, x["url"]) == i + 1), 1, limit)


def prefixed(contexts: Column, header: Column) -> Column:
    """A map of named contexts, each after the header and a blank line; a blank context is the header alone."""
    return F.transform_values(contexts, lambda _, text: F.when(F.trim(F.coalesce(text, F.lit(""))) == "", header).otherwise(F.concat(header, F.lit("\n\n"), text)))


def rerank(hits: DataFrame, score: Column | None = None, cap: int = 1500) -> DataFrame:
    """``hits`` (score, summary) by another stage's score, held to 0..1, where it gave one; summaries are cut at ``cap``."""
    told = F.lit(None).cast("double") if score is None else score
    return hits.withColumns({"score": F.coalesce(F.when(told.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), told))), F.col("score")), "summary": F.substring("summary", 1, cap)})


def answer(docs: DataFrame, query: list[str], limit: int, contradictions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """From a question to a cited answer: search, rerank, contradictions, lines with citations."""
    hits = search(docs, query, limit, id_col, text_col).join(docs.select(F.col(id_col).cast("string").alias("citation_id"), F.col(text_col).alias("text")), "citation_id")
    hits = rerank(hits.withColumn("summary", F.lit(None).cast("string"))).withColumn("query", F.lit(" ".join(query)))
    return cited_answer(hits, hits.select("query", "citation_id"), contradictions)
