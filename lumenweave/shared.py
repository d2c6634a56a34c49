"""The cluster's shared folder: lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder set by ``setCheckpointDir``.

    Where a session that runs on this machine alone has neither, a temporary
    folder is set up; on a cluster each executor would write to its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        option = sc._jsc.sc().getCheckpointDir()
        if option.isDefined():
            found = option.get()
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            found = "file://" + tempfile.mkdtemp(prefix="lumenweave-")
            sc.setCheckpointDir(found)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lumenweave-{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts lineage: what is downstream survives lost executors without computing
    this part again, and several consumers share one computation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a written table that nothing reads any more."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lumenweave-" in root:
            target = spark._jvm.org.apache.hadoop.fs.Path(root)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
