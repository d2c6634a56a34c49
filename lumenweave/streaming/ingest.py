"""Streaming ingest: documents and events as they arrive, late data bounded by watermarks.

An extension: the batch operators apply to what these streams write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def documents(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def once(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once; state is dropped when the watermark has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, group: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, group, n, total) of tumbling windows, given when the watermark closes them."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("start"), group, "n", "total")


def write(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, what has arrived so far, then stop; restarts go on where the checkpoint ends."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
