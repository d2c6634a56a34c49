"""Sinks: JSON lines, keyed upserts into Parquet tables, write-once snapshots, Markdown and HTML reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.operators.merging import keep_first, upsert
from lumenweave.operators.numbering import dense_numbers


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line; null fields are written."""
    df.write.option("ignoreNullFields", "false").mode("errorifexists").json(path)


def write_table(df: DataFrame, path: str, keys: list[str]) -> None:
    """Upsert into a Parquet table: a new version is written beside the old one and named by the newest folder."""
    spark = df.sparkSession
    versions = table_versions(df, path)
    rows = df if not versions else upsert(spark.read.parquet(f"{path}/v{versions[-1]:06d}"), df, keys)
    rows.write.parquet(f"{path}/v{(versions[-1] + 1 if versions else 0):06d}")


def table_versions(df: DataFrame, path: str) -> list[int]:
    """Versions whose write was committed."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    done = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName()[1:]) for p in done)


def read_table(spark, path: str) -> DataFrame:
    versions = table_versions(spark.range(0), path)
    if not versions:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v{versions[-1]:06d}")


def publish_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write once, never over; returns (file, rows, digest), the digest independent of row order."""
    df.write.mode("errorifexists").parquet(path)
    again = df.sparkSession.read.parquet(path)
    # Sums of hashes are the same in any order, and are added up task by task.
    sums = [F.sum(F.xxhash64(F.lit(k), "h").cast("decimal(38,0)")).cast("string") for k in range(4)]
    digest = F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256)
    per_file = again.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.sha2(F.to_json(F.struct(*again.columns)), 256).alias("h"))
    return per_file.groupBy("file").agg(F.count("*").alias("rows"), digest.alias("digest"))


def write_once_cache(cache: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Entries under new keys; a key that is there already is never replaced, of new ones the first content counts."""
    new = keep_first(fresh.join(cache.select(key), key, "left_anti"), [key], [F.to_json(F.struct(*[c for c in fresh.columns if c != key]))])
    return cache.unionByName(new.select(*cache.columns))


def escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def markdown_report(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, report): a heading and a line a field for each group's rows."""
    line = F.concat_ws("\n", *[F.concat(F.lit(f"- {f}: "), F.coalesce(F.col(f).cast("string"), F.lit("NR"))) for f in fields])
    body = F.array_join(F.array_sort(F.collect_list(line)), "\n\n")
    return rows.groupBy(group).agg(F.concat(F.lit("## "), F.first(F.col(group).cast("string")), F.lit("\n\n"), body).alias("report"))


def html_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One ``tr`` a row, cells escaped, missing ones empty."""
    cells = [F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def fixed_columns(rows: DataFrame, header: list[str], default: str = "NR") -> DataFrame:
    """Columns in the template's order; those not in the rows, and nulls, hold the default, others than the template's are left out."""
    return rows.select(*[F.coalesce(F.col(h).cast("string"), F.lit(default)).alias(h) if h in rows.columns else F.lit(default).alias(h) for h in header])


def append_log(current: DataFrame, events: DataFrame, *order: str) -> DataFrame:
    """``events`` with ``seq`` going on from the log's last, to be appended to it; numbered without gathering them in one task."""
    last = current.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return dense_numbers(events, "seq", *order).withColumn("seq", F.col("seq").cast("long") + F.lit(last))
