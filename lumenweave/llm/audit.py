"""Filter interaction audit: what each filter of a chain removes, in every order, from one count of failures.

A document fails some filters, which is a mask of bits.  Once documents are
counted by part and mask, no order needs the documents again: the survivors of
a set S of filters are the documents whose mask lies within the filters left
out, a sum over subsets.  The subset-zeta transform turns the counts of all
masks into these sums, one pass a filter.  A step of an order then is the
difference between two neighbouring sets, for labelled documents likewise.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, materialize

LETTERS = "ABCDE"
#: What is counted: documents, and those of them with a label.
COUNTED = ("n", "good", "toxic")


@dataclass(frozen=True)
class AuditSpec:
    """Bounds of the filters: A too short, B too few distinct words, C too many capitals, D marks; E, a repeated text, has none."""

    min_words: int = 200
    min_distinct_percent: int = 50
    max_upper_percent: int = 2
    marks: str = "#$%&*|"


def failures(docs: DataFrame, spec: AuditSpec = AuditSpec()) -> DataFrame:
    """doc_id, part, digest of the text, mask of the filters A to D that its text fails; one row per input row.

    Null texts and sources are empty.  Only these few bytes of a document leave the scan.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    trimmed = F.trim("text", F.lit(SPACE_CHARS))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
    cut = slim.select(
        "doc_id",
        "part",
        F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("digest"),
        words.alias("words"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > spec.max_upper_percent * F.length("text").cast("long")).alias("upper"),
        F.rlike("text", F.lit(f"[{spec.marks}]")).alias("marked"),
    )
    n, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    failed = [n < spec.min_words, 100 * distinct < spec.min_distinct_percent * n, F.col("upper"), F.col("marked")]
    return cut.select("doc_id", "part", "digest", sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)), F.lit(0)).alias("mask"))


def with_repeats(failed: DataFrame, bit: int) -> DataFrame:
    """``failed`` with ``bit`` added to the mask of each row whose text a smaller doc_id has.

    The least id of each text is found by an aggregate and meets its rows by text and id together, so that a group of
    copies of any size is dealt over all tasks.  A null id is neither smaller nor larger than any.
    """
    first = failed.groupBy(F.col("digest").alias("f_digest")).agg(F.min("doc_id").alias("f_id"))
    joined = failed.join(first, (F.col("digest") == F.col("f_digest")) & (F.col("doc_id") == F.col("f_id")), "left")
    again = F.col("doc_id").isNotNull() & F.col("f_id").isNull()
    return joined.select("doc_id", "part", (F.col("mask") + F.when(again, F.lit(bit)).otherwise(F.lit(0))).alias("mask"))


def with_labels(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``failed`` with good and toxic, 1 or 0; of repeated labels of an id, one of value 1 suffices."""
    one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("long"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    joined = failed.join(known.filter("good + toxic > 0"), F.col("doc_id") == F.col("l_id"), "left")
    return joined.select("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTED[1:]])


def mask_counts(marked: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: at most 2^filters rows a part, counted before the shuffle."""
    return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(c).cast("long").alias(c) for c in COUNTED[1:]])


def survivors(counts: DataFrame, filters: int) -> DataFrame:
    """part and one array each of ``COUNTED``: at T the count of documents that fail no filter outside T."""
    size = 1 << filters
    grouped = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.col("mask").cast("int"), F.struct(*COUNTED)))).alias("at"))
    masks = F.sequence(F.lit(0), F.lit(size - 1))
    zero = F.lit(0).cast("long")

    def by_mask(c: str) -> Column:
        return F.transform(masks, lambda m: F.coalesce(F.try_element_at("at", m)[c], zero)).alias(c)

    def summed(c: str, bit: int) -> Column:
        """Where the bit is set, what the same place without it has is added."""
        return F.transform(c, lambda x, t: x + F.when(t.bitwiseAND(bit) != 0, F.get(c, t - bit)).otherwise(zero)).alias(c)

    z = grouped.select("part", *map(by_mask, COUNTED))
    for i in range(filters):
        z = z.select("part", *[summed(c, 1 << i) for c in COUNTED])
    return z


def steps(z: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, with what the step leaves, takes and loses.

    redundant: documents failing the step's filter that went before; unique_fails: those that fail it alone; shapley:
    what it removes, summed over all orders, which is a weighted sum over the sets that may stand before it.
    """
    k = len(letters)
    everything = (1 << k) - 1

    def alone(i: int) -> Column:
        """Removed by filter i over all orders: each set before it stands in |S|! (k - 1 - |S|)! of them."""
        before = [s for s in range(1 << k) if not s >> i & 1]
        terms = [factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) * (F.get("n", F.lit(everything - s)) - F.get("n", F.lit(everything - s - (1 << i)))) for s in before]
        return sum(terms[1:], terms[0])

    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    wide = z.select("*", F.array(*[alone(i) for i in range(k)]).alias("by_filter"))
    rows = wide.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bits = lambda n: sum((F.when((F.instr("filter_order", c) <= n), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(letters)), F.lit(0))
    own = F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    rows = rows.select("*", (F.lit(everything) - bits(F.col("step") - 1)).alias("before"), (F.lit(everything) - bits(F.col("step"))).alias("after"), own.alias("own"))
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    bit = F.get(F.array(*[F.lit(1 << i) for i in range(k)]), F.col("own"))
    fails = F.get("n", F.lit(everything)) - F.get("n", F.lit(everything) - bit)
    return rows.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        F.get("n", F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (fails - lost("n")).alias("redundant"),
        (F.get("n", bit) - F.get("n", F.lit(0))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("by_filter", F.col("own")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, spec: AuditSpec = AuditSpec()) -> DataFrame:
    """The steps of all orders of the five filters, per part.

    Null texts and sources are empty, and a null source is one part with the empty one.  Rows repeated in the input are
    counted each; of one doc_id they do not repeat one another.  Rows of a null id have no labels and repeat nothing.
    Labels of no document count nowhere.  An empty table has no parts and gives no rows.  Further columns of either
    table are not looked at, whatever their names.
    """
    failed = materialize(failures(docs, spec), "failures")
    return steps(survivors(mask_counts(with_labels(with_repeats(failed, 1 << 4), labels)), len(LETTERS)))
