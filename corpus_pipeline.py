"""From raw documents to packed training sequences: language, quality, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it to the shared folder and gives what it reads back to the next.  A document is
known by its doc_id; all stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm import jaccard, language, mixing, packing, quality
from lumenweave.llm.common import fresh_names, materialize, table
from lumenweave.llm.queries import tokenizer_path

#: Three times what random vectors of so many dimensions have by chance; texts of fewer characters may well have less.
LEAST_COSINE, LEAST_CHARS = 3 / language.DIMENSIONS**0.5, 100


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language go: without letters, or long and no nearer to any prototype than chance.

    Null and empty texts have no letters.  Learned only from documents that are not held out.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang") if len(kept) < len(docs.columns) else docs
    found = language.identify(whole, language.learn(docs, language.not_held_out))
    left = found.filter((F.col("lang_pred") != language.UNKNOWN) & ((F.col("lang_score") >= LEAST_COSINE) | (F.length("text") < LEAST_CHARS)))
    return left.select(*docs.columns) if whole is docs else left.select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; each row is judged by its own text, whatever its id."""
    return quality.judge(docs, table(spark, sf_dir, "labels"), carry=True).filter("kept").select("row.*")


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """Documents with a digest of all their columns: ids may repeat or be null, and then do not tell rows apart."""
    return docs.withColumn(name, F.xxhash64(*[F.col(c).isNull() for c in docs.columns], *docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id (null last) and then digest; blank texts are in no group and stay.

    Rows with a null id, or with one id and different texts, are documents of their own.
    """
    row, k_row, k_blank = fresh_names(docs, "row_key", "kept_key", "blank")
    keyed = _keyed(docs, row)
    groups = materialize(jaccard.join(keyed, id_col=row, count_links=False), "duplicate-groups")
    grouped, blank = groups.filter("n_shingles > 0"), groups.filter("n_shingles = 0").select(F.col("doc_id").alias(k_row)).distinct()
    ids = keyed.select(F.col(row).alias("key"), F.col("doc_id").alias("id")).distinct()
    named = grouped.select(F.col("doc_id").alias("key"), "component_id").distinct().join(ids, "key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))["key"].alias(k_row))
    keep = first.select(k_row, F.lit(False).alias(k_blank)).union(blank.select(k_row, F.lit(True)))
    found = keyed.join(keep, F.col(row) == F.col(k_row))
    rows = grouped.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("distinct")).first()
    if rows["rows"] > rows["distinct"]:
        found = found.filter(F.col(k_blank)).unionByName(found.filter(~F.col(k_blank)).dropDuplicates([row]))
    return found.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; repeated rows as often as the one of them that it takes most."""
    row, k_row, times, turn = fresh_names(docs, "row_key", "kept_key", "times", "turn")
    keyed = _keyed(docs, row)
    plan = mixing.mix(keyed, carry=(row,)).filter("copies > 0").groupBy(F.col(row).alias(k_row)).agg(F.max("copies").alias(times))
    taken = keyed.join(plan, F.col(row) == F.col(k_row))
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(turn)).drop(turn)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    packed = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: No SQL expresses the stages that learn, join by similarity or tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
