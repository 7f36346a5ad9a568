"""The incremental ingest as file-source streams: every file lands once, however often the job runs or fails.

A batch of a stream is a unit of the landing protocol (``sources.landing``), named by the stream's checkpoint and the batch's
number.  Spark repeats a batch that was not finished with the same files and the same number, and a unit that is published
already is skipped, so nothing lands twice.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from moundworks.sources.ingest import SCHEMA, read_csvs, season_window
from moundworks.sources.landing import land

FILES_A_BATCH = 200


def _unit(checkpoint: str, batch: int) -> str:
    return f"stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{batch}"


def land_stream(spark: SparkSession, source: str, table: str, checkpoint: str, schema: T.StructType = SCHEMA) -> StreamingQuery:
    """Land new Parquet files of ``source`` in the yearly table and stop when all have been read."""
    rows = spark.readStream.schema(schema).parquet(source)

    def each(batch: DataFrame, number: int) -> None:
        land(season_window(batch), table, _unit(checkpoint, number))

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def land_csv_stream(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """The same for CSV files whose headers differ: a batch's files are united by name, some hundred at a time.

    The stream itself carries the files' names only; their contents are read as in ``ingest.read_csvs``.
    """
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", FILES_A_BATCH).option("pathGlobFilter", "*.csv").load(source).select("path")

    def each(batch: DataFrame, number: int) -> None:
        files = sorted(r["path"] for r in batch.collect())  # FILES_A_BATCH names
        if files:
            land(season_window(read_csvs(batch.sparkSession, files)), table, _unit(checkpoint, number))

    return names.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
