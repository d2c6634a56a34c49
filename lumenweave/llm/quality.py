"""Quality rules with risk-controlled thresholds (native).

Rules measure a text; a rule rejects a document at or above its cutoff.  The
cutoffs are not set by hand: on a labelled holdout, each rule of each stratum
goes down a fixed grid from the loosest cutoff and stops before the first whose
false rejections of good documents are not provably below ``alpha``.  The proof
is an exact binomial test (the Clopper-Pearson bound inverted): the chance of
so few rejections, were the true rate ``alpha``, must not exceed ``delta``
shared out over strata and rules.  Going down a grid fixed in advance and
stopping at the first failure needs no further correction.  A rule without
proof rejects nothing in that stratum.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, materialize

SYMBOLS = r"#*$%&|<>"
#: Every rule's measure over the counts, and its grid of cutoffs.
MEASURES = {
    "symbols": "n_symbols / n_words",
    "capitals": "n_upper / word_chars",
    "repeats": "n_repeat_words / n_words",
    "dup_lines": "n_dup_lines / n_lines",
}


@dataclass(frozen=True)
class QualitySpec:
    """``alpha``: false rejections allowed to all rules of a stratum together, at confidence 1 - ``delta``."""

    alpha: float = 0.02
    delta: float = 0.05
    grid: tuple[float, ...] = tuple(g / 20 for g in range(20, 0, -1))
    min_words: int = 50
    max_repeat_percent: int = 50
    rules: tuple[str, ...] = field(default=tuple(MEASURES))


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper and n_lines.

    Whole texts; a null text counts as empty.  Windows of three words are
    compared by 64-bit hashes of the words.  Only texts with an equal pair of
    windows are sorted by hash, which finds all equal windows in n log n.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.trim(text, F.lit(SPACE_CHARS))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
    length_of = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    step = docs.select(
        "*",
        words.alias("_words"),
        lines.alias("_lines"),
        length_of(f"[{SPACE}]+").alias("word_chars"),
        length_of(f"[^{SYMBOLS}]+").alias("n_symbols"),
        length_of(r"\P{Lu}+").alias("n_upper"),
    )
    window = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    step = step.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= 3, F.slice(window, F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0)))).otherwise(F.array().cast("array<long>")).alias("_windows"),
    ).drop("_words", "_lines")
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    step = step.select("*", F.when(twice, placed).alias("_placed")).drop("_windows")
    same = lambda x, i, d: F.coalesce(F.get("_placed", i + d)["h"] == x["h"], F.lit(False))
    repeated = F.filter("_placed", lambda x, i: same(x, i, -1) | same(x, i, 1))
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))
    return step.select("*", F.coalesce(F.when(F.col("_placed").isNotNull(), F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words")).drop("_placed")


def base_failed(spec: QualitySpec) -> Column:
    return (F.col("n_words") < spec.min_words) | (100 * F.col("n_repeat_words") > spec.max_repeat_percent * F.col("n_words"))


def measured(counted: DataFrame, spec: QualitySpec) -> DataFrame:
    """``counted`` with one column a rule, 0 where the denominator is 0."""
    return counted.select("*", *[F.coalesce(F.try_divide(*[F.col(x.strip()).cast("double") for x in MEASURES[r].split("/")]), F.lit(0.0)).alias(f"m_{r}") for r in spec.rules])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed exactly in log space term by term."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), start, add, lambda a: a["s"])


def cutoffs(labelled: DataFrame, spec: QualitySpec) -> DataFrame:
    """stratum, rule, cutoff from labelled good documents (stratum and measures), for proven cutoffs only.

    Each good document is counted once in the grid cell of each measure, before
    the shuffle; what comes back is at most strata x rules x grid rows.
    """
    grid = F.array(*[F.lit(g) for g in spec.grid])
    # Position in the grid of the loosest cutoff that the measure reaches; the grid's size when none.
    cell = lambda m: F.size(F.filter(grid, lambda g: g > F.col(m)))
    long = labelled.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), cell(f"m_{r}").alias("cell")) for r in spec.rules])).alias("x")).select("stratum", "x.*")
    hits = materialize(long.groupBy("stratum", "rule", "cell").agg(F.count("*").alias("hits")), "grid-counts")
    strata = F.lit(hits.select("stratum").distinct().count())
    totals = hits.groupBy("stratum", "rule").agg(F.sum("hits").alias("n"), F.collect_list(F.struct("cell", "hits")).alias("by_cell"))
    steps = totals.withColumn("level", F.lit(spec.delta) / (strata * len(spec.rules))).select(
        "stratum", "rule", "n", "level", "by_cell", F.posexplode(grid).alias("step", "cutoff")
    )
    alpha = spec.alpha / len(spec.rules)
    k = F.aggregate("by_cell", F.lit(0).cast("long"), lambda a, x: a + F.when(x["cell"] <= F.col("step"), x["hits"]).otherwise(0))
    tested = steps.withColumn("k", k).withColumn("ok", F.when(F.col("k") >= F.col("n") * alpha, F.lit(False)).otherwise(binomial_tail(F.col("k"), F.col("n"), alpha) <= F.col("level")))
    down = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return (
        tested.withColumn("ok", F.min("ok").over(down)).filter("ok")
        .groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    )


#: Strata whose cutoffs go to the tasks as a broadcast; those of more are joined by a shuffle.
MOST_STRATA = 10_000


def judge(docs: DataFrame, labels: DataFrame, spec: QualitySpec = QualitySpec(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, counts, base_failed, rejected_by, kept; with ``carry`` also ``row``, a struct of the input's columns.

    Null and empty texts have no words and fail the base rules; a null stratum
    is a stratum of its own; repeated rows are judged alike; an empty table
    gives an empty result; without labels only the base rules reject.  The
    holdout is the labelled documents of quality 1 that pass the base rules.
    """
    carried = [F.struct(*docs.columns).alias("row")] if carry else []
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text"), *carried)
    counted = counts(slim).drop("text").withColumn("base_failed", base_failed(spec))
    table = materialize(measured(counted, spec), "quality")
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("label_id")).distinct()
    holdout = table.filter(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("label_id"), "left_semi")
    once = holdout.groupBy("doc_id").agg(F.min(F.struct("stratum", *[f"m_{r}" for r in spec.rules])).alias("x"))
    found = cutoffs(once.select("x.*"), spec).groupBy("stratum").pivot("rule", list(spec.rules)).agg(F.min("cutoff"))
    found = materialize(found.select(F.col("stratum").alias("c_stratum"), *[F.col(r).alias(f"c_{r}") for r in spec.rules]), "cutoffs")
    found = F.broadcast(found) if found.count() <= MOST_STRATA else found
    judged = table.join(found, F.col("stratum").eqNullSafe(F.col("c_stratum")), "left")
    over = F.array_compact(F.array(*[F.when(F.col(f"m_{r}") >= F.col(f"c_{r}"), F.lit(r)) for r in spec.rules]))
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    return judged.withColumn("rejected_by", over).withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "base_failed", "rejected_by", "kept", *(["row"] if carry else [])
    )
