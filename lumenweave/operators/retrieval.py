"""Lexical and vector retrieval as aggregations; top-k without a global sort of the corpus."""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.text import tokens
from lumenweave.shared import written

K1, B = 1.5, 0.75


def scored(docs: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text", **extra: Column) -> DataFrame:
    """(id, score, extra) of all documents.  A query term that repeats counts repeatedly.

    Texts are cut into words once: lengths and counts of the query's terms are
    written out by document, together with ``extra`` columns over the words
    ``_w``; frequencies and the average length are one small row over that.
    """
    terms = sorted(set(query))
    times = lambda q: F.size(F.filter("_w", lambda t: t == q))
    count = [times(q).alias(f"tf{i}") for i, q in enumerate(terms)]
    sized = docs.select(F.col(id_col), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_w")).select(id_col, F.size("_w").alias("len"), *count, *[c.alias(name) for name, c in extra.items()])
    sized = written(sized, "term-counts")
    stats = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n, mean = stats["n"], stats["avg"] or 1.0
    score = F.lit(0.0)
    for i, q in enumerate(terms):
        df, tf = float(stats[f"df{i}"]), F.col(f"tf{i}").cast("double")
        idf = F.log(F.lit((n - df + 0.5) / (df + 0.5) + 1.0))
        score = score + query.count(q) * idf * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * F.col("len") / F.lit(float(mean))))
    return sized.select(id_col, score.alias("score"), *extra)


def bm25(docs: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of documents with a positive score."""
    return scored(docs, query, id_col, text_col).filter("score > 0")


def hashed_places(words: Column) -> Column:
    """Each word's dimension of 256, as two hex digits: what the first 32 bits of its MD5 leave when divided by 256."""
    return F.transform(words, lambda w: F.substring(F.md5(w), 7, 2))


def hashed_length(places: Column) -> Column:
    """Length of the vector of counts: a word more in a dimension of n words adds 2n + 1 to its square."""
    step = lambda acc, d: F.when(acc["d"] == d, F.struct(d.alias("d"), (acc["n"] + 1).alias("n"), (acc["t"] + 2 * acc["n"] + 1).alias("t"))).otherwise(F.struct(d.alias("d"), F.lit(1).cast("long").alias("n"), (acc["t"] + 1).alias("t")))
    start = F.struct(F.lit("").alias("d"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("t"))
    return F.sqrt(F.aggregate(F.array_sort(places), start, step, lambda acc: acc["t"].cast("double")))


def hashed_cosine(places: Column, query: list[str]) -> Column:
    """Cosine of a text's hashed vector, by its words' places, with a query's; null for a text without words."""
    at: Counter = Counter()
    for word in query:
        at[hashlib.md5(word.encode()).hexdigest()[6:8]] += 1
    def cosine_of(held: Column) -> Column:
        times = lambda d: F.size(F.filter(held, lambda p: p == d))
        dot = sum((float(n) * times(d) for d, n in sorted(at.items())), F.lit(0.0))
        return F.try_divide(dot, hashed_length(held) * F.lit(sum(n * n for n in at.values()) ** 0.5))

    # The places are worked out once: the array has one element.
    return F.get(F.transform(F.array(places), cosine_of), 0)


def top_k(ranked: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows; each partition keeps k before they meet."""
    return ranked.orderBy(*order).limit(k)


def top_k_by(ranked: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank``."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, from -1 to 1; null if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, size(a) * size(b))


def hybrid(lexical: Column, cosine_score: Column, most_lexical: Column) -> Column:
    """0.65 of the lexical score's share of the best, 0.35 of the cosine cut to 0..1."""
    return 0.65 * F.coalesce(F.try_divide(lexical, most_lexical), F.lit(0.0)) + 0.35 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine_score))
