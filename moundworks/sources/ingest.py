"""Landing yearly pitch files in one partitioned table."""

from __future__ import annotations

import csv
from collections import defaultdict
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADERS = 200
LONG, DOUBLE, STRING, INT = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType()
SCHEMA = T.StructType(
    [T.StructField(c, LONG) for c in ("game_pk", "at_bat_number", "pitch_number")]
    + [T.StructField("game_date", T.DateType()), T.StructField("pitcher", LONG), T.StructField("stand", STRING), T.StructField("pitch_type", STRING)]
    + [T.StructField(c, DOUBLE) for c in ("release_speed", "plate_x", "plate_z", "pfx_x", "pfx_z", "release_pos_x", "release_pos_z", "release_extension")]
    + [T.StructField(c, INT) for c in ("balls", "strikes", "outs_when_up", "inning")]
    + [T.StructField("events", STRING), T.StructField("description", STRING), T.StructField("launch_speed", DOUBLE)]
)


def season_window(pitches: DataFrame) -> DataFrame:
    """March to November of each year, with game_year."""
    return pitches.where(F.month("game_date").between(3, 11)).withColumn("game_year", F.year("game_date"))


def not_landed(new: DataFrame, landed: DataFrame) -> DataFrame:
    """Rows of years that the landed table does not hold yet."""
    return new.join(landed.select("game_year").distinct(), "game_year", "left_anti")


def typed(rows: DataFrame, schema: T.StructType = SCHEMA) -> DataFrame:
    """Columns of the schema cast (what cannot be cast is null, NaN is null, absent is null), others passed on."""

    def column(field: T.StructField):
        if field.name not in rows.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        value = F.col(field.name).try_cast(field.dataType)
        return (F.when(~F.isnan(value), value) if field.dataType == DOUBLE else value).alias(field.name)

    known = {f.name for f in schema}
    return rows.select(*[column(f) for f in schema], *[c for c in rows.columns if c not in known])


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All frames united by column name, absent columns null."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole


def read_csvs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files with headers that differ by file, united by name.

    A directory of CSVs is read by position, so files (or folders of files with one header) are grouped by their
    header line and each group is read as strings once; there is no inference pass over the data.
    """
    if not paths:
        raise FileNotFoundError("no CSV files to read")
    groups = defaultdict(list)
    for path, header in headers(spark, paths).items():
        groups[header].append(path)
    if not groups:
        raise ValueError("the CSV files are empty")
    frames = []
    for header, files in groups.items():
        schema = T.StructType([T.StructField(c, STRING) for c in header])
        frames.append(spark.read.csv(files, header=True, schema=schema, enforceSchema=True))
    return typed(union_by_name(frames))


def headers(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, ...]]:
    """The column names in each file's first line; empty files are left out.  One job for some hundred files."""
    found = {}
    for start in range(0, len(paths), HEADERS):
        some = paths[start : start + HEADERS]
        first = [spark.read.text(p).where("_metadata.file_block_start = 0").limit(1).select(F.lit(k).alias("k"), "value") for k, p in enumerate(some)]
        for r in reduce(DataFrame.union, first).collect():  # a line per file
            found[some[r["k"]]] = tuple(c.strip() for c in next(csv.reader([r["value"].lstrip("\ufeff")])))
    return found


def write_table(pitches: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per year; within it rows are clustered by pitcher and date, so row groups prune lookups."""
    rows = pitches if "game_year" in pitches.columns else pitches.withColumn("game_year", F.year("game_date"))
    dealt = rows.hint("rebalance", F.col("game_year"), F.col("pitcher"))  # Spark splits partitions, as a hot pitcher's, by their bytes
    dealt.sortWithinPartitions("game_year", "pitcher", "game_date").write.mode(mode).partitionBy("game_year").parquet(path)


def landed_years(spark: SparkSession, path: str) -> set[int]:
    """The years in the table; none if there is no table yet.  A table that cannot be read is an error, as its years would
    land twice."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return set()
    return {r[0] for r in table.select("game_year").distinct().collect()}  # a row per year


def table_stats(table: DataFrame) -> DataFrame:
    """Rows, games and pitchers per year."""
    return table.groupBy("game_year").agg(F.count("*").alias("n"), F.countDistinct("game_pk").alias("games"), F.countDistinct("pitcher").alias("pitchers"))
