"""The corpus pipeline: each stage works on all that its predecessor kept."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lumenweave.llm import jaccard, mixing, quality
from lumenweave.llm.common import materialize

from .conftest import SF


def test_stages(spark, small_docs):
    planted = small_docs.unionByName(small_docs.filter("doc_id < 9").withColumn("doc_id", F.col("doc_id") + 100_000))
    planted = planted.unionByName(spark.createDataFrame([(-1, "1234 5678 " * 60, "en", "src1", 600), (-2, None, None, None, None)], planted.schema))
    docs, seen = planted, []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), "stage")
        if name != "packing":
            assert out.columns == small_docs.columns
        seen.append((docs, out))
        docs = out
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    assert {-1, -2} == ids(seen[0][0]) - ids(seen[0][1])
    judged = quality.judge(seen[1][0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(seen[1][1]) == ids(judged.filter("kept"))
    kept = ids(seen[2][1])
    groups = jaccard.join(seen[2][0]).collect()
    assert kept == {g.component_id for g in groups} and not any(i >= 100_000 for i in kept)
    assert seen[2][1].count() == len(kept)
    assert ids(seen[3][1]) <= kept and max(Counter(r.doc_id for r in seen[3][1].collect()).values()) == 2
    assert ids(docs) == ids(seen[3][1])
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    copies = Counter(r.doc_id for r in seen[3][1].collect())
    assert all(r.n == r.t * copies[r.doc_id] for r in pieces)


def test_repeated_ids_and_empty_tables(spark, small_docs):
    twice = small_docs.limit(20).union(small_docs.limit(20))
    assert corpus_pipeline.near_duplicates(spark, twice, SF).count() == corpus_pipeline.near_duplicates(spark, small_docs.limit(20), SF).count()
    docs = small_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_texts_under_one_id_or_none(spark, small_docs):
    """Different texts under a repeated or null id are documents of their own, in both stages that look rows up."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    rows = [(5, a), (5, b), (3, b + " more"), (None, c), (None, d), (None, d + " more"), (7, c), (8, None), (None, ""), (3, b + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], small_docs.schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert sum(got.values()) == 6 and got.keys() >= {(5, a), (3, b + " more"), (7, c), (8, None), (None, "")}
    assert len(got.keys() & {(None, d), (None, d + " more")}) == 1
    # The mixture looks rows up by the same key: a short and a long text under one id keep their own numbers of copies.
    twice = spark.createDataFrame([(1, f"{x} " * n, "en", s, 1) for s in ("s0", "s1", "s2") for x in "abcdef" for n in (1, 90)], small_docs.schema)
    plan = mixing.mix(twice.withColumn("k", F.concat("source", "text")), carry=("k",))
    want = Counter({r.k: r.copies for r in plan.collect() if r.copies})
    mixed = Counter(r.source + r.text for r in corpus_pipeline.mix_sources(spark, twice, SF).collect())
    assert len(set(want.values())) > 1 or len(want) < 36
    assert sum(mixed.values()) == sum(want.values())


def test_clashing_columns(spark, small_docs):
    """Columns named like those that stages and operators make come out of every stage as they went in."""
    names = ["row", "row_key", "kept_key", "times", "turn", "blank", "copies", "copy", "k_id", "lang_pred", "found", "n_words", "toxic", "stratum", "size", "kept", "own"]
    docs = small_docs.limit(120).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == small_docs.columns + names, name
        assert docs.filter(" OR ".join(f"{c} IS DISTINCT FROM concat('{c}', doc_id)" for c in names)).count() == 0 and docs.count() > 20, name
    assert corpus_pipeline.pack(spark, docs, SF).count() > 0


def test_unlearned_script_goes(spark, small_docs):
    georgian = " ".join("".join(chr(0x10D0 + (7 * i * j + i + j * j) % 33) for j in range(3 + i % 6)) for i in range(60))
    docs = small_docs.unionByName(spark.createDataFrame([(-5, georgian, None, None, 1)], small_docs.schema))
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.filter("doc_id = -5").count() == 0
    assert kept.count() == small_docs.filter("text RLIKE '\\\\p{L}'").count()
