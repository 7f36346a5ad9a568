"""Landing in units that are there whole or not at all, however often a job is run.

A unit (a year's files, a batch of a stream) is written to a folder of its own, ``landing=<id>``, where nobody looks yet, and
then published by one row per year in the table's manifest: its files with their row counts.  The manifest is appended to
by one file, so a reader sees a unit or does not; readers take the files that the manifest lists and nothing else.  A job that
fails or is killed before that leaves an unlisted folder at most (``unlisted`` finds them), and is run again as if it had
never been.  A unit that is in the manifest is skipped; should two jobs publish the same unit at once, the earlier landing
counts and the other is never read.

This needs no rename and no lock, so it holds on object stores too.  The manifest lies in ``_manifest``, which Spark does not
take for data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from moundworks.sources.ingest import SCHEMA, landed_years, read_csvs, season_window, write_table

MANIFEST = "unit string, landing string, game_year int, n_rows long, files array<struct<file: string, n: long>>"
#: For a reader of an empty table.
EMPTY = "landing string, game_year int"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The published units of a table, those published twice once: a row per unit and year."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        landed = landed_years(spark, path)  # an error where there is a table that cannot be read
        if landed:
            raise ValueError(f"{path} holds a table without a manifest; land in a new folder")
        rows = spark.createDataFrame([], MANIFEST)
    first = F.min("landing").over(Window.partitionBy("unit"))  # a row per year
    return rows.withColumn("first", first).where("landing = first").drop("first").distinct()


def land(new: DataFrame, path: str, unit: str) -> int | None:
    """Write rows as a unit and publish it; the number of rows, or None if the unit is there already.

    A unit without rows is published as such, so that it is not asked for again.
    """
    spark = new.sparkSession
    known = manifest(spark, path)
    if not known.where(F.col("unit") == unit).isEmpty():
        return None
    landing = f"{known.select('landing').distinct().count():09d}-{uuid.uuid4().hex}"  # in the order of publishing
    write_table(new, f"{path}/landing={landing}")
    try:
        staged = spark.read.parquet(f"{path}/landing={landing}")
        files = staged.groupBy(F.col("game_year").cast("int").alias("game_year"), F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))
        files = files.withColumn("file", F.regexp_extract("path", "(landing=[^/]*/.*)$", 1))  # once a file
        rows = files.groupBy("game_year").agg(F.sum("n").alias("n_rows"), F.sort_array(F.collect_list(F.struct("file", "n"))).alias("files"))  # names of files
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # no file was written
            raise
        rows = spark.createDataFrame([(None, 0, [])], "game_year int, n_rows long, files array<struct<file: string, n: long>>")
    rows = rows.select(F.lit(unit).alias("unit"), F.lit(landing).alias("landing"), "game_year", "n_rows", "files")
    rows.coalesce(1).write.mode("append").parquet(f"{path}/_manifest")
    return manifest(spark, path).where((F.col("unit") == unit) & (F.col("landing") == landing)).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]


def read_table(spark: SparkSession, path: str, years: tuple[int, ...] | None = None, landings: tuple[str, ...] | None = None) -> DataFrame:
    """The table of what has been published, with game_year: exactly the files of the manifest, of all or some years.

    landings: read these alone, and say in ``landing`` which one a row is of.
    """
    rows = manifest(spark, path)
    rows = rows if years is None else rows.where(F.col("game_year").isin(*years))
    rows = rows if landings is None else rows.where(F.col("landing").isin(*landings))
    files = [f"{path}/{r['file']}" for r in rows.select(F.explode("files.file").alias("file")).collect()]  # what a scan's driver lists anyway
    if not files:
        last = [T.StructField("game_year", T.IntegerType()), *([] if landings is None else [T.StructField("landing", T.StringType())])]
        return spark.createDataFrame([], T.StructType([*SCHEMA.fields, *last]))
    found = spark.read.option("mergeSchema", True).option("basePath", path).parquet(*files)
    return found.drop("landing") if landings is None else found.withColumn("landing", F.col("landing").cast("string"))


def unlisted(spark: SparkSession, path: str) -> list[str]:
    """Landings with data that no unit reads: left by jobs that failed before they published, or published second.

    Landings under way are among them, so delete (``shared.discard``) only while none is.
    """
    there = {r[0] for r in spark.read.parquet(path).select("landing").distinct().collect()}  # a row per landing
    return sorted(f"{path}/landing={x}" for x in there - {r[0] for r in manifest(spark, path).select("landing").collect()})


def land_years(spark: SparkSession, files: dict[int, list[str]], path: str, check: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Land the CSV files of years that have not landed; a year that fails is reported and does not stop the rest.

    check: looks at a year's rows on their way and may raise.  Returns game_year, status ('landed', 'skipped', 'empty' or the
    error).
    """
    rows, done = [], {r[0] for r in manifest(spark, path).select("game_year").distinct().collect()}  # a row per year
    for year, paths in sorted(files.items()):
        if year in done:
            rows.append((year, "skipped"))
            continue
        try:
            new = season_window(read_csvs(spark, paths)).where(F.col("game_year") == year)
            if new.isEmpty():
                rows.append((year, "empty"))
                continue
            found = land(check(new) if check else new, path, f"year-{year}")
            rows.append((year, "skipped" if found is None else "landed"))
        except Exception as error:
            rows.append((year, str(error).splitlines()[0][:200]))
    return spark.createDataFrame(rows, "game_year int, status string")
