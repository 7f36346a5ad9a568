"""Filters and projections over pitches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks.functions.constants import CLEAN_COLUMNS, MIN_PITCHES, TRAINING_FLOOR, VALID_ARSENAL


def valid_pitches(pitches: DataFrame) -> DataFrame:
    """The twelve valid codes with speed, movement and location; null and NaN alike are missing."""
    return pitches.where(F.col("pitch_type").isin(*VALID_ARSENAL)).na.drop(subset=list(CLEAN_COLUMNS))


def is_valid() -> Column:
    """The same as a flag, never null."""
    flag = F.coalesce(F.col("pitch_type").isin(*VALID_ARSENAL), F.lit(False))
    for c in CLEAN_COLUMNS:
        flag = flag & F.col(c).isNotNull() & ~F.isnan(F.coalesce(F.col(c), F.lit(0.0)))
    return flag


def date_window(requests: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Requests with both ends: the end defaults to as_of, the start to so many days before the end."""
    end = F.coalesce("end_date", F.to_date(F.lit(as_of)))
    return requests.withColumn("end_date", end).withColumn("start_date", F.coalesce("start_date", F.date_sub("end_date", days)))


def training_rows(pitches: DataFrame, floor: str = TRAINING_FLOOR, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows that sequences are made of: on or after the floor, with type, speed and plate_x; keep: more columns to pass on."""
    columns = ("game_pk", "at_bat_number", "pitch_number", "pitcher", "pitch_type", "release_speed", "plate_x", "plate_z", "balls", "strikes", "stand")
    rows = pitches.where((F.col("game_date") >= F.to_date(F.lit(floor))) & F.col("pitch_type").isNotNull())
    return rows.na.drop(subset=["release_speed", "plate_x"]).select(*columns, *keep)


def min_sample_guard(clean: DataFrame, key: str = "pitcher", least: int = MIN_PITCHES) -> DataFrame:
    """Per key the number of clean pitches and whether that is enough."""
    return clean.groupBy(key).agg(F.count("*").alias("n")).withColumn("accepted", F.col("n") >= least)


def locations(clean: DataFrame) -> DataFrame:
    """Locations for plots: nulls are 0, movement in inches."""
    rows = clean.na.fill(0.0, subset=list(CLEAN_COLUMNS))
    return rows.withColumns({"pfx_x": F.col("pfx_x") * 12.0, "pfx_z": F.col("pfx_z") * 12.0})


def movement_scatter(rows: DataFrame) -> DataFrame:
    """Movement points with both numbers present, mirrored in x, one decimal."""
    there = rows.where(F.col("pfx_x").isNotNull() & F.col("pfx_z").isNotNull() & ~F.isnan("pfx_x") & ~F.isnan("pfx_z"))
    one = lambda c: F.floor(c * 10.0 + 0.5) / 10.0
    return there.withColumns({"x": one(-F.col("pfx_x")), "z": one(F.col("pfx_z"))})


def active_types(rows: DataFrame, types: tuple[str, ...] = VALID_ARSENAL) -> DataFrame:
    """Pitches of the chosen types with both plate coordinates."""
    return rows.where(F.col("pitch_type").isin(*types) & F.col("plate_x").isNotNull() & F.col("plate_z").isNotNull())
