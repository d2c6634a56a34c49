"""A stored inverted index: lexical search that does not read the corpus again.

A segment holds what was appended at once: postings in blocks, and as its
commit a row with the number of documents and of their words.  Postings lie in
folders by a hash of their term, so that a question reads the buckets of its
terms only.  A term's postings are put in the order of what they can add to a
score and cut into blocks; a block tells the most that any of its postings can
add, so that blocks which cannot lift a document into the first k are left out.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions.text import tokens
from lumenweave.operators.retrieval import B, K1, top_k
from lumenweave.shared import written

#: Postings of a block; postings of a frequent term that are put in order together; blocks of a term looked at first.
BLOCK, SHARE, PROBE = 128, 4096, 4
BUCKETS = 64
#: No token is empty: under this term each document has one posting.
EVERY = ""


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def segments(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the segments that are committed."""
    root, fs = _folder(spark, f"{path}/stats")
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root)]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def postings(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """Blocks of the committed segments: of these terms, by reading their buckets, or all."""
    done = segments(spark, path)
    if not done:
        raise FileNotFoundError(path)
    kind = spark.read.parquet(f"{path}/stats").filter(F.col("segment") == done[0]).first()["doc_type"]
    schema = f"term string, share long, block int, n int, frontier array<struct<tf:int,len:int>>, postings array<struct<doc:{kind},tf:int,len:int>>, segment int, bucket int"
    blocks = spark.read.schema(schema).parquet(f"{path}/postings").filter(F.col("segment").isin(done))
    if terms is None:
        return blocks.filter(F.col("term") != EVERY)
    return blocks.filter(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})) & F.col("term").isin(sorted(set(terms))))


def _frontier(block: Column) -> Column:
    """(tf, len) of the postings that no other surpasses, with more of the term in fewer words; one of them adds the most, whatever the mean length."""
    by_length = F.array_sort(F.transform(block, lambda x: F.struct(x["len"].alias("len"), (-x["tf"]).alias("less"))))
    start = F.struct(F.lit(0).alias("most"), F.array().cast("array<struct<tf:int,len:int>>").alias("held"))
    point = lambda x: F.struct((-x["less"]).cast("int").alias("tf"), x["len"].cast("int").alias("len"))
    step = lambda a, x: F.when(-x["less"] > a["most"], F.struct((-x["less"]).cast("int").alias("most"), F.array_append(a["held"], point(x)).alias("held"))).otherwise(a)
    return F.aggregate(by_length, start, step, lambda a: a["held"])


def _counted(words: Column) -> Column:
    """(term, tf) of each different word, as an array: runs of the sorted words, so that counting shuffles nothing."""
    opens = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    ends = lambda s, at: F.array_append(F.slice(at, F.lit(2), F.size(at)), F.size(s))
    runs = lambda s, at: F.zip_with(at, ends(s, at), lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).alias("tf")))
    return F.flatten(F.transform(F.array(F.array_sort(words)), lambda s: F.flatten(F.transform(F.array(opens(s)), lambda at: runs(s, at)))))


def append(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Add documents as a segment and return its number.  Null texts have no words; rows of a null id are not indexed.

    An id that is indexed already is refused, as is one that is repeated here.  A writer that loses a race for a number
    fails before it has committed anything.
    """
    spark = docs.sparkSession
    done = segments(spark, path)
    number = done[-1] + 1 if done else 0
    slim = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("w"))
    words = slim.select("doc", F.size("w").alias("len"), F.explode(_counted(F.array_append("w", F.lit(EVERY)))).alias("t"))
    counts = written(words.select("doc", "len", "t.term", "t.tf"), "term-counts")
    every = counts.filter(F.col("term") == EVERY)
    size = every.agg(F.sum("tf").alias("n"), F.countDistinct("doc").alias("ids"), F.sum("len").alias("words")).first()
    if (size["n"] or 0) > size["ids"]:
        raise ValueError("documents to be indexed have ids of their own each")
    if done and not postings(spark, path, [EVERY]).select(F.explode("postings.doc").alias("doc")).join(every, "doc", "left_semi").isEmpty():
        raise ValueError("some of the documents are indexed already")

    mean = max(1.0, (size["words"] or 0) / max(1, size["n"] or 0))
    # Terms of many documents are shared out by document; no more than that many can be so frequent.
    per_term = counts.groupBy("term").agg(F.count("*").alias("df"))
    frequent = max(SHARE, -(-counts.count() // 100_000))
    shared = per_term.filter(F.col("df") > frequent).select("term", F.ceil(F.col("df") / SHARE).alias("shares"))
    dealt = counts.join(F.broadcast(shared), "term", "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("doc"), "shares"), F.lit(0).cast("long")))
    weight = lambda x: x["tf"] / (x["tf"] + K1 * (1 - B + B * x["len"] / F.lit(mean)))
    gathered = dealt.groupBy("term", "share").agg(F.collect_list(F.struct("doc", "tf", "len")).alias("p"))
    ordered = gathered.select("term", "share", F.array_sort(F.transform("p", lambda x: F.struct((-weight(x)).alias("w"), x["doc"].alias("doc"), x["tf"].alias("tf"), x["len"].alias("len")))).alias("p"))
    cut = ordered.select("term", "share", "p", F.explode(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / BLOCK).cast("int"))).alias("block"))
    block = cut.select("term", "share", "block", F.transform(F.slice("p", F.col("block") * BLOCK + 1, F.lit(BLOCK)), lambda x: F.struct(x["doc"].alias("doc"), x["tf"].alias("tf"), x["len"].alias("len"))).alias("postings"))
    block = block.select("term", "share", "block", F.size("postings").alias("n"), _frontier(F.col("postings")).alias("frontier"), "postings", _bucket(F.col("term")).alias("bucket"))
    block = block.repartition("bucket", F.pmod("share", F.lit(8))).sortWithinPartitions("bucket", "term", "share", "block")
    block.write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/postings/segment={number}")
    spark.range(1).select(F.lit(size["n"] or 0).cast("long").alias("n"), F.lit(size["words"] or 0).cast("long").alias("words"), F.lit(counts.schema["doc"].dataType.simpleString()).alias("doc_type")).write.mode("errorifexists").parquet(f"{path}/stats/segment={number}")
    return number


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, cf, max_tf) of the whole index."""
    tf = F.aggregate("postings.tf", F.lit(0).cast("long"), lambda a, x: a + x)
    return postings(spark, path).groupBy("term").agg(F.sum("n").alias("df"), F.sum(tf).alias("cf"), F.max(F.array_max("frontier.tf")).alias("max_tf"))


class Question:
    """A question's terms, with what the index says about them; ``least`` is the score that the first k reach at least."""

    def __init__(self, spark: SparkSession, path: str, query: list[str], k: int):
        self.blocks, self.k = postings(spark, path, query), k
        stats = spark.read.parquet(f"{path}/stats").filter(F.col("segment").isin(segments(spark, path))).agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        n, self.mean = stats["n"] or 0, (stats["words"] or 0) / (stats["n"] or 1) or 1.0
        held = self.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max(self._most()).alias("most")).collect()
        idf = {r["term"]: query.count(r["term"]) * _idf(n, r["df"]) for r in held}
        self.factor = {t: idf[t] for t in sorted(idf)}
        self.most = {r["term"]: idf[r["term"]] * r["most"] for r in held}
        self.least = self._least()

    def _weight(self, tf: Column, length: Column) -> Column:
        tf = tf.cast("double")
        return tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length / F.lit(float(self.mean))))

    def _most(self) -> Column:
        """The most that a posting of a block can add, before the factor of its term."""
        return F.array_max(F.transform("frontier", lambda x: self._weight(x["tf"], x["len"])))

    def _by_term(self, values: dict[str, float]) -> Column:
        out = F.lit(0.0)
        for term, value in values.items():
            out = F.when(F.col("term") == term, F.lit(float(value))).otherwise(out)
        return out

    def bound(self) -> Column:
        """The most that a document of a block can score, whatever else it holds."""
        others = {t: sum(self.most.values()) - m for t, m in self.most.items()}
        return self._by_term(self.factor) * self._most() + self._by_term(others)

    def scores(self, blocks: DataFrame) -> DataFrame:
        """(doc, score) by these blocks alone."""
        each = blocks.select("term", F.explode("postings").alias("p")).select("term", "p.*")
        return each.groupBy("doc").agg(F.sum(self._by_term(self.factor) * self._weight(F.col("tf"), F.col("len"))).alias("score"))

    def _least(self) -> float:
        """The k-th best score by each term's most promising blocks; scores only grow by further ones."""
        best = None
        for term in self.factor:
            own = top_k(self.blocks.filter(F.col("term") == term), PROBE, self._most().desc())
            best = own if best is None else best.unionByName(own)
        if best is None:
            return 0.0
        found = top_k(self.scores(best), self.k, F.desc("score")).agg(F.min("score").alias("s"), F.count("*").alias("n")).first()
        # A little less, so that rounding leaves out no block.
        return found["s"] * (1 - 1e-9) if found["n"] == self.k else 0.0

    def kept(self) -> DataFrame:
        """The blocks that may hold one of the first k."""
        return self.blocks.filter(self.bound() >= self.least)


def _idf(n: int, df: int) -> float:
    from math import log

    return log((n - df + 0.5) / (df + 0.5) + 1.0)


def search(spark: SparkSession, path: str, query: list[str], k: int) -> DataFrame:
    """(doc, score): the first ``k`` by BM25, ties by id; the same scores as a scan of all documents gives."""
    asked = Question(spark, path, query, k)
    scored = asked.scores(asked.kept()).filter("score > 0")
    return top_k(scored.withColumn("score", F.round("score", 6)), k, F.desc("score"), F.asc("doc"))
