"""Five-pitch windows over the global order of pitches, and the encoders of their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundworks.functions.constants import FEATURES, SEQUENCE, TRAINING_LIMIT
from moundworks.sources.shared import spread

BLOCK = 100_000
ORDER = ("game_pk", "at_bat_number", "pitch_number")
BOUNDARIES = {"global": (), "game": ("game_pk",), "pitcher_game": ("game_pk", "pitcher")}


def pitch_order(rows: DataFrame) -> DataFrame:
    """idx: the row's place (from 0) in the order of games, at-bats and pitches.

    Games are counted, their offsets summed over the game table alone, and rows numbered within their game, so
    no task ever holds more than a game's pitches or the list of games.
    """
    games = rows.groupBy("game_pk").agg(F.count("*").alias("_n"))
    offsets = games.select("game_pk", (F.sum("_n").over(Window.orderBy("game_pk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("game_pk").orderBy("at_bat_number", "pitch_number"))
    return spread(rows, "game_pk").withColumn("_own", own).join(offsets, "game_pk").withColumn("idx", (F.col("_offset") + F.col("_own") - 1).cast("long")).drop("_own", "_offset")


def label_codes(rows: DataFrame) -> DataFrame:
    """kind, value, code: alphabetical dense codes of pitch types and batter sides; a null side comes last."""
    values = rows.select(F.lit("pitch_type").alias("kind"), F.col("pitch_type").alias("value")).distinct()
    values = values.unionByName(rows.select(F.lit("stand").alias("kind"), F.col("stand").alias("value")).distinct())
    return codes_of(values)


def codes_of(values: DataFrame) -> DataFrame:
    """kind, value (distinct) with their codes."""
    code = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("value").asc_nulls_last())) - 1  # a row per class
    return values.withColumn("code", code.cast("int"))


def encoded(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """rows with label (code of the pitch type) and stand_code."""
    of = lambda kind, column, name: codes.where(F.col("kind") == kind).select(F.col("value").alias(f"_{column}"), F.col("code").alias(name))
    rows = rows.join(F.broadcast(of("pitch_type", "pitch_type", "label")), F.col("pitch_type") == F.col("_pitch_type"))  # a few dozen classes
    rows = rows.join(F.broadcast(of("stand", "stand", "stand_code")), F.col("stand").eqNullSafe(F.col("_stand")))
    return rows.drop("_pitch_type", "_stand")


def scaler_stats(rows: DataFrame) -> DataFrame:
    """One row: mean and population deviation of each feature, nulls left out, deviation 0 counted as 1."""
    parts = []
    for c in FEATURES:
        deviation = F.stddev_pop(c)
        parts += [F.avg(c).alias(f"{c}_mean"), F.when(deviation == 0, 1.0).otherwise(deviation).alias(f"{c}_std")]
    return rows.agg(*parts)


def scaled(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Features as (x - mean) / std; nulls stay null."""
    joined = rows.crossJoin(F.broadcast(stats))  # stats is one row
    scaled_columns = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in FEATURES}
    return joined.withColumns(scaled_columns).drop(*stats.columns)


def windows(rows: DataFrame, columns: tuple[str, ...], label: str, size: int = SEQUENCE, limit: int | None = TRAINING_LIMIT, boundary: str = "global", block: int = BLOCK) -> DataFrame:
    """idx, label and <column>_1 .. <column>_size (oldest first) of every row with ``size`` rows before it.

    rows has idx.  Blocks of consecutive rows are windowed on their own; the last rows of a block are copied to
    the next one, so every window is whole and no task sees more than a block.  With a boundary other than
    'global' a window never crosses a game, or a pitcher within it.
    """
    if block < size:
        raise ValueError(f"a block must hold at least {size} rows")
    keys = BOUNDARIES[boundary]
    rows = rows if limit is None else rows.where(F.col("idx") < limit)
    own, later = F.floor(F.col("idx") / block), F.floor((F.col("idx") + size) / block)
    if keys:
        over = Window.partitionBy(*keys).orderBy("idx")  # a game's pitches
        rows = rows.withColumn("_block", own)
    else:
        over = Window.partitionBy("_block").orderBy("idx")
        rows = rows.withColumn("_block", F.explode(F.array_distinct(F.array(own, later))))
        rows = spread(rows, "_block") if limit is None else rows
    lags: dict[str, Column] = {f"{c}_{size - k + 1}": F.lag(c, k).over(over) for k in range(size, 0, -1) for c in columns}
    made = rows.select("idx", "_block", F.col(label).alias("label"), F.lag("idx", size).over(over).alias("_first"), *[v.alias(k) for k, v in lags.items()])
    return made.where((F.col("_block") == own) & F.col("_first").isNotNull()).drop("_block", "_first")


def sequence_dataset(rows: DataFrame, limit: int | None = TRAINING_LIMIT, boundary: str = "global", block: int = BLOCK, codes: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Scaled, encoded windows of training rows: encoders (if none are given) fit on all rows, windows on the first ``limit``."""
    coded = encoded(rows, label_codes(rows) if codes is None else codes)
    ready = pitch_order(scaled(coded, scaler_stats(coded) if stats is None else stats))
    return windows(ready, FEATURES, "label", limit=limit, boundary=boundary, block=block)
