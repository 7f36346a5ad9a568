"""Data behind the plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundworks.functions.constants import MAX_LOCATIONS, VALID_ARSENAL

CELL, ORIGIN_X, ORIGIN_Z = 0.25, -1.75, 1.0
SALTS = 16
STEPS = 8  # of the sample's order while it grows e-fold
KEY = ("game_pk", "at_bat_number", "pitch_number")
#: A fixed pseudo-random order of pitches that every engine can compute.
SAMPLE_ORDER = "((game_pk * 7919 + at_bat_number * 104729 + pitch_number * 1299709) % 1000003)"


def heatmap(rows: DataFrame, keys: tuple[str, ...] = ("pitcher",)) -> DataFrame:
    """Counts in quarter-foot cells (negative indexes are kept) with centre, intensity, hue, opacity, drawn x."""
    cell = lambda c, origin: F.floor((F.col(c) - origin) / CELL).cast("long")
    cells = rows.where("plate_x IS NOT NULL AND plate_z IS NOT NULL").groupBy(*keys, cell("plate_x", ORIGIN_X).alias("xi"), cell("plate_z", ORIGIN_Z).alias("zi")).agg(F.count("*").alias("count"))
    most = F.max("count").over(Window.partitionBy(*keys))  # over cells, not pitches
    shaded = cells.withColumn("intensity", F.col("count") * 1.0 / most)
    x = F.col("xi") * CELL + ORIGIN_X + CELL / 2
    return shaded.withColumns({"x": x, "z": F.col("zi") * CELL + ORIGIN_Z + CELL / 2, "drawn_x": -x, "hue": 0.6 - F.col("intensity") * 0.6, "opacity": F.col("intensity") * 0.6 + 0.3})


def velocity_bins(rows: DataFrame, key: str = "pitcher") -> DataFrame:
    """Pitches per whole mph and type."""
    speed = F.floor(F.col("release_speed") + 0.5).cast("long")
    return rows.where("release_speed IS NOT NULL").groupBy(key, speed.alias("speed"), "pitch_type").agg(F.count("*").alias("count"))


def velocity_histogram(rows: DataFrame, key: str = "pitcher") -> DataFrame:
    """One row per whole mph: a column per type (null if none) and the total."""
    sums = [F.sum(F.when(F.col("pitch_type") == t, F.col("count"))).alias(t) for t in VALID_ARSENAL]
    return velocity_bins(rows, key).groupBy(key, "speed").agg(F.sum("count").alias("total"), *sums)


def pitch_types(rows: DataFrame, key: str = "pitcher") -> DataFrame:
    return rows.select(key, "pitch_type").distinct()


def location_sample(rows: DataFrame, key: str = "pitcher", most: int = MAX_LOCATIONS) -> DataFrame:
    """At most so many pitches per key in the fixed order.

    A first pass counts pitches per key and step of the order (steps grow with their distance from 0, so there are few), which
    bounds the sample's last step; the second pass sorts the pitches up to that step alone, a little more than the sample.
    """
    order = (F.expr(SAMPLE_ORDER), F.col("game_pk"), F.col("at_bat_number"), F.col("pitch_number"))
    stepped = rows.withColumn("_step", F.coalesce(F.signum(order[0]) * F.ceil(F.log1p(F.abs(order[0])) * STEPS), F.lit(float("-inf"))))  # nulls first
    counts = stepped.groupBy(F.col(key).alias("_key"), F.col("_step").alias("_last")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_last").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")  # a row per step
    last = counts.withColumn("_before", before).where(F.col("_before") < most).groupBy("_key").agg(F.max("_last").alias("_last"))
    near = stepped.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_step") <= F.col("_last")))
    first = near.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= most)
    return first.drop("_r", "_step", "_key", "_last")
