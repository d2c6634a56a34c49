"""Sources: tolerant JSONL, corpus discovery, codebooks, key=value files, run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenweave.functions.text import study_id


def tolerant_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON objects, one a line; lines that are malformed or no objects are skipped."""
    lines = spark.read.text(path).filter(F.trim("value").startswith("{"))
    kind = schema if isinstance(schema, str) else schema.simpleString()
    inner = kind.removeprefix("struct<").removesuffix(">") if kind.startswith("struct<") else kind
    parsed = lines.select(F.from_json("value", f"{inner}, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.filter("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")


def discover(spark: SparkSession, folder: str, pattern: str = "*", study: str | None = None, year: str | None = None) -> DataFrame:
    """(path, study_id, n_bytes) of a folder's files that fit the pattern, of one study or year if asked for; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("n_bytes"))
    found = found.withColumn("study_id", study_id(F.col("path")))
    if study:
        return found.filter(F.col("study_id") == study)
    return found.filter(F.col("study_id").startswith(f"{year}-")) if year else found


def codebook(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """(sheet, column, field) of a JSON mapping {"columns": [{"column", "field"}]}."""
    raw = spark.read.schema("columns array<struct<column: string, field: string>>").json(path, multiLine=True)
    return raw.select(F.lit(sheet).alias("sheet"), F.explode("columns").alias("c")).select("sheet", "c.*")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a key=value file; comments and blank lines are skipped, quotes around values dropped, the last of a key counts."""
    rows = spark.read.text(path).select(F.trim("value").alias("x"), F.monotonically_increasing_id().alias("n")).filter("x <> '' AND NOT startswith(x, '#') AND instr(x, '=') > 1")
    pair = rows.select(F.trim(F.regexp_extract("x", "^([^=]+)=", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract("x", "^[^=]+=(.*)$", 1)), "^[\"']|[\"']$", "").alias("value"), "n")
    return pair.groupBy("key").agg(F.max_by("value", "n").alias("value"))


def prefixed(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose id is ``prefix`` or begins with it and a hyphen."""
    return rows.filter((F.col(column) == prefix) | F.col(column).startswith(f"{prefix}-"))


def distinct_values(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each field's distinct values under a key, as JSON: a scalar if there is one, else a sorted list."""
    def folded(c: str):
        values = F.array_sort(F.collect_set(F.col(c).cast("string")))
        return F.when(F.size(values) == 1, F.get(values, 0)).otherwise(F.to_json(values)).alias(c)

    return rows.groupBy(key).agg(*[folded(c) for c in columns])
