"""Arsenal statistics with run values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundworks.functions.constants import MIN_PER_TYPE, MIN_PITCHES
from moundworks.functions.expressions import PITCH_NAME, RUN_VALUE, rounded

#: name -> (expression over the group, decimals)
MEASURES = {
    "run_value_per_100": ("rv * 1e0 / count", 2),
    "avg_velocity": ("velocity", 1),
    "pfx_x": ("px * 12e0", 1),
    "pfx_z": ("pz * 12e0", 1),
    "plate_x": ("lx", 2),
    "plate_z": ("lz", 2),
    "release_pos_x": ("rx", 2),
    "release_pos_z": ("rz", 2),
    "release_extension": ("ext", 2),
}
AVERAGES = {"velocity": "release_speed", "px": "pfx_x", "pz": "pfx_z", "lx": "plate_x", "lz": "plate_z", "rx": "release_pos_x", "rz": "release_pos_z", "ext": "release_extension"}


def with_run_value(pitches: DataFrame) -> DataFrame:
    """rv: the pitch's run value in hundredths."""
    return pitches.withColumn("rv", F.expr(RUN_VALUE))


def with_names(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pitch_name", F.expr(PITCH_NAME))


def raw_arsenal(clean: DataFrame, key: str = "pitcher") -> DataFrame:
    """Per key and type: count, share of all clean pitches, averages; types with few pitches still in.

    One hash aggregation with partial sums; the share's window then sees at most twelve rows per key.
    """
    groups = with_run_value(clean).groupBy(key, "pitch_type").agg(F.count("*").alias("count"), F.sum("rv").alias("rv"), *[F.avg(c).alias(a) for a, c in AVERAGES.items()])
    return with_total(groups, key)


def with_total(groups: DataFrame, key: str) -> DataFrame:
    """total: the key's pitches of all types."""
    return groups.withColumn("total", F.sum("count").over(Window.partitionBy(key)))


def arsenal(clean: DataFrame, key: str = "pitcher", least: int = MIN_PITCHES, least_type: int = MIN_PER_TYPE) -> DataFrame:
    """The arsenal of every key with enough pitches, without rarely thrown types."""
    return shown(raw_arsenal(clean, key), key, least, least_type)


def shown(groups: DataFrame, key: str, least: int = MIN_PITCHES, least_type: int = MIN_PER_TYPE) -> DataFrame:
    """What an arsenal shows of raw groups."""
    groups = groups.where((F.col("total") >= least) & (F.col("count") >= least_type))
    shares = F.expr(rounded("count * 100e0 / total", 1)).alias("percentage")
    return groups.select(key, "pitch_type", "count", shares, *[F.expr(rounded(e, n)).alias(c) for c, (e, n) in MEASURES.items()])


def noise_filter(clean: DataFrame, key: str = "pitcher", least_type: int = MIN_PER_TYPE) -> DataFrame:
    """Types and shares shown; hidden types still count in the denominator."""
    return raw_arsenal(clean, key).where(F.col("count") >= least_type).select(key, "pitch_type", "count", F.expr(rounded("count * 100e0 / total", 1)).alias("percentage"))


def run_value_totals(pitches: DataFrame) -> DataFrame:
    """Runs saved or given per pitcher and type, in hundredths and per 100 pitches; negative is good."""
    sums = with_run_value(pitches).groupBy("pitcher", "pitch_type").agg(F.count("*").alias("count"), F.sum("rv").alias("rv_cents"))
    return sums.withColumn("rv_per_100", F.expr(rounded("rv_cents * 1e0 / count", 2)))


def ranked(rows: DataFrame, key: str = "pitcher") -> DataFrame:
    """Arsenal rows by share, with the run-value bar (0 to 100, half drawn on a side) and its sign."""
    order = Window.partitionBy(key).orderBy(F.desc("percentage"), "pitch_type")
    bar = F.expr("least(abs(run_value_per_100) / 5e0 * 100e0, 100e0)")
    return with_names(rows).select(key, F.row_number().over(order).alias("rank"), "pitch_type", "pitch_name", "percentage", bar.alias("bar"), (bar / 2.0).alias("drawn"), F.when(F.col("run_value_per_100") < 0, "good").otherwise("bad").alias("sign"))
