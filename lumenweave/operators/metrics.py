"""Scoring: guarded ratios, the order of outcomes, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of grades and of findings.
GRADE_WEIGHTS = {"EXACT": 1.0, "EQUIVALENT": 1.0, "MINOR": 0.5, "PARTIAL": 0.25, "WRONG": 0.0}
FINDING_WEIGHTS = {"correct": 1.0, "acceptable": 0.8, "gold_ambiguous": 0.75, "missing": 0.3, "incorrect": 0.0, "partially_incorrect": 0.4}


def rate(numerator: Column, denominator: Column) -> Column:
    """Their quotient as a double; null, not zero, without a denominator."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def classify(gold: Column, pred: Column, matched: Column, supported: Column | None = None) -> Column:
    """The outcome of a target from gold and predicted status (null prediction: entity missing); the order decides."""
    supported = F.lit(True) if supported is None else supported
    return (
        F.when(gold == "REVIEW_REQUIRED", None)
        .when(gold == "SOURCE_CONFLICT", F.when(pred == "SOURCE_CONFLICT", "SOURCE_CONFLICT_DETECTED").otherwise("SOURCE_CONFLICT_MISSED"))
        .when(~supported, "REQUIRED_BUT_UNSUPPORTED")
        .when(pred.isNull(), "ENTITY_MISSING")
        .when(pred == "SOURCE_CONFLICT", "SOURCE_CONFLICT_SPURIOUS")
        .when(pred.isin("UNRESOLVED", "INSUFFICIENT_CONTEXT"), "NOT_EXTRACTED")
        .when((gold == pred) & (gold != "PRESENT"), "EXACT")
        .when(gold == pred, F.when(matched, "EXACT").otherwise("VALUE_WRONG"))
        .when(pred == "PRESENT", "FALSE_PRESENT")
        .when((gold == "PRESENT") & (pred == "NOT_REPORTED"), "FALSE_NR")
        .otherwise("STATUS_WRONG")
    )


def weight(c: Column, weights: dict[str, float]) -> Column:
    """The weight of a label; null for labels without one, which then count nowhere."""
    out = F.lit(None).cast("double")
    for name, w in weights.items():
        out = F.when(c == name, F.lit(w)).otherwise(out)
    return out


def pick_counts(c: Column, names: list[str]) -> list[Column]:
    """A count of each name, zeros kept."""
    return [F.count_if(c == n).alias(n.lower()) for n in names]


def finding_score(statuses: Column) -> Column:
    """0 to 100 from an array of a row's findings, by their weights; unknown ones count nowhere, and null is none known."""
    known = F.filter(F.transform(statuses, lambda x: weight(F.lower(F.trim(x)), FINDING_WEIGHTS)), lambda w: w.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, w: a + w) / F.size(known)
    return F.when(F.size(known) > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.bround(100 * mean, 0).cast("int"))))


def module_mean(rows: DataFrame, key: str, modules: list[str], replaced: str, other: str) -> DataFrame:
    """(key, mean): the mean of module scores, half to even, with one module's score taken from another column."""
    scores = [F.col(other if m == replaced else m) for m in modules]
    return rows.select(key, F.bround(sum(scores[1:], scores[0]) / len(scores), 2).alias("mean"))


def row_audit(expected: DataFrame, scored: DataFrame, group: str, row: str, score: str) -> DataFrame:
    """(group, n_rows, n_missing, mean): the mean of valid scores (0 to 100) over the rows that were expected; others count nowhere."""
    valid = F.when(F.col(score).between(0, 100), F.col(score))
    return expected.join(scored, [group, row], "left").groupBy(group).agg(F.count("*").alias("n_rows"), F.count_if(valid.isNull()).alias("n_missing"), F.avg(valid).alias("mean"))


def registry_audit(registry: DataFrame, schema: DataFrame) -> DataFrame:
    """(field_id, finding) of a registry (field_id, value_type, enabled) against a schema (field_id, value_type).

    UNREGISTERED, INVALID (enabled but unknown to the schema), TYPE_MISMATCH, DUPLICATE or OK; a disabled field counts as registered.
    """
    counted = registry.groupBy("field_id").agg(F.count("*").alias("n"), F.first("value_type").alias("r_type"), F.max("enabled").alias("enabled"))
    both = counted.join(schema.select("field_id", F.col("value_type").alias("s_type")), "field_id", "full")
    finding = (
        F.when(F.col("n").isNull(), "UNREGISTERED").when(F.col("n") > 1, "DUPLICATE").when(F.col("s_type").isNull() & F.col("enabled"), "INVALID")
        .when(F.col("s_type").isNotNull() & (F.col("r_type") != F.col("s_type")), "TYPE_MISMATCH").otherwise("OK")
    )
    return both.select("field_id", finding.alias("finding"))


#: How a field's classification counts among its kind's layers, and which root cause it belongs to.
LAYERS = {"exact": ("EXACT",), "wrong_value": ("VALUE_WRONG",), "wrong_status": ("STATUS_WRONG", "FALSE_NR", "FALSE_PRESENT"), "not_extracted": ("NOT_EXTRACTED",), "entity_missing_cascade": ("ENTITY_MISSING",)}
ROOTS = {"COVERAGE": ("NOT_EXTRACTED",), "VALUE": ("VALUE_WRONG",), "STATUS": ("FALSE_NR", "FALSE_PRESENT", "STATUS_WRONG"), "CONFLICT": ("SOURCE_CONFLICT_MISSED", "SOURCE_CONFLICT_SPURIOUS"), "EVIDENCE": ("EVIDENCE_UNGROUNDED",)}


def benchmark_summary(fields: DataFrame, kinds: list[str]) -> DataFrame:
    """(section, a, b, n) of judged fields (kind, classification, gold_status, matched, field), by one aggregation.

    targets: fields by kind.  layer: fields with an ordinary status by kind and layer.  root: by root cause; a missing
    entity's fields are losses of structure.  abstained: by field, where the entity was found and nothing was said.
    Fields under review count nowhere; kinds, layers and causes without any count 0.
    """
    named = lambda table: F.coalesce(*[F.when(F.col("classification").isin(*c), F.lit(n)) for n, c in table.items()])
    ordinary = F.col("gold_status").isin("PRESENT", "NOT_REPORTED", "NOT_APPLICABLE")
    told = fields.filter("gold_status <> 'REVIEW_REQUIRED'").select(
        "kind", F.when(ordinary, named(LAYERS)).alias("layer"), F.coalesce(F.when((F.col("classification") == "ENTITY_MISSING") & ~F.col("matched"), F.lit("STRUCTURE")), named(ROOTS)).alias("root"),
        F.when(F.col("matched") & (F.col("classification") == "NOT_EXTRACTED"), F.col("field")).alias("abstained"),
    )
    sets = [[F.col("kind"), F.col("layer")], [F.col("kind")], [F.col("root")], [F.col("abstained")]]
    by = [F.grouping(c).alias(f"no_{c}") for c in ("kind", "layer", "root", "abstained")]
    counted = told.groupingSets(sets, "kind", "layer", "root", "abstained").agg(F.count("*").alias("n"), *by)
    section = F.when(F.col("no_abstained") == 0, "abstained").when(F.col("no_root") == 0, "root").when(F.col("no_layer") == 0, "layer").otherwise("targets")
    # A null that was grouped by, rather than left out of the grouping, is no layer, cause or abstention.
    some = counted.filter(" AND ".join(f"(no_{c} = 1 OR {c} IS NOT NULL)" for c in ("layer", "root", "abstained")))
    rows = some.select(section.alias("section"), F.coalesce("kind", "root", "abstained").alias("a"), F.col("layer").alias("b"), "n")
    zeros = [("layer", k, n) for k in kinds for n in LAYERS] + [("targets", k, None) for k in kinds] + [("root", r, None) for r in ("STRUCTURE", *ROOTS)]
    none = fields.sparkSession.createDataFrame(zeros, "section string, a string, b string").withColumn("n", F.lit(0).cast("long"))
    return rows.unionByName(none).groupBy("section", "a", "b").agg(F.sum("n").alias("n"))


def bucket_counts(rows: DataFrame, bucket: str, names: list[str], id_col: str, most_ids: int = 5) -> DataFrame:
    """(bucket, n, ids): every named bucket, those without rows too, and its first ids; rows of other buckets are left out.

    A report's lists are short: at most ``most_ids`` of a bucket, which each task brings down to before they meet.
    """
    known = rows.filter(F.col(bucket).isin(*names)).select(F.col(bucket).alias("bucket"), F.col(id_col).alias("id"))
    order = Window.partitionBy("bucket").orderBy("id")
    first = known.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most_ids).groupBy("bucket").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    counted = known.groupBy("bucket").agg(F.count("*").alias("n")).join(first, "bucket")
    every = rows.sparkSession.createDataFrame([(n,) for n in names], "bucket string")
    kind = counted.schema["ids"].dataType
    return every.join(F.broadcast(counted), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.array().cast(kind)).alias("ids"))
