"""Folders that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS = 250_000  # about so many rows of a table for each partition
MOST = 5  # times as many, before there are more partitions than Spark writes to without a sort


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a local folder is set in local mode (tests), and a cluster is an error:
    its executors would not share the driver's folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="moundworks-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, within: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (or below a folder in it) and read it back: cuts lineage."""
    path = f"{within}/{name}-{uuid.uuid4().hex}" if within else shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *keys: str, of: DataFrame | None = None) -> DataFrame:
    """rows dealt by keys to as many partitions as the rows of their files (or those of ``of``) ask for, so that what one task
    sorts does not grow with the table.  It is left to Spark only where the session's number and its cores are enough: Spark joins
    shuffled partitions up to a size in bytes, whatever the session's number, but keeps one for each core.  Beyond
    ``spark.shuffle.sort.bypassMergeThreshold`` partitions the tasks that deal the rows sort all they read in memory, so partitions
    take up to ``MOST`` times as many rows before there are more.  The files are Parquet, and their footers are counted, nothing else is read."""
    spark, files = rows.sparkSession, (rows if of is None else of).inputFiles()
    parts = math.ceil(spark.read.parquet(*files).count() / ROWS) if files else 0
    enough = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    unsorted = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return rows.repartition(max(min(parts, unsorted), math.ceil(parts / MOST)), *keys) if parts > enough else rows


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a shared folder whose contents no later stage reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
