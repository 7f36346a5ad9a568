"""Aggregates of a landed table that are stored by landing and folded on read: what has landed before is never read again.

Four kinds of state, each a small table in ``<table>/_states`` (which Spark does not take for data):

- ``moments``: count, mean and sum of squared deviations of each feature.  Means are kept as a whole number near them plus an
  offset, and states are merged around a common centre, so nothing is lost where values are large and lie close together.
- ``classes``: training rows by pitch type and by batter side.  Label codes follow from these; so do the mean and deviation of
  the side's code, which cannot be stored, since a new class changes the codes of others.
- ``run_values``: rows and run value in hundredths by pitcher and type.
- ``bitmaps``: the distinct games and pitchers of a year, a bit each, in buckets of 32,768 numbers.  Merging is a bitwise or,
  so the counts are exact over any landings.  Ids are numbers that lie near each other; scattered ones would take 4 KB each.

``refresh`` reads the landings that have no state of a kind yet and appends theirs by one file; a job that fails before leaves
nothing.  A landing without rows of a kind leaves a marker.  Should two jobs append the same landing's states, those of one
job count.  Readers take the states of published landings only (``landing.manifest``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundworks.functions.constants import FEATURES
from moundworks.functions.expressions import rounded
from moundworks.operators import arsenal, clean
from moundworks.operators.sequences import codes_of
from moundworks.sources import landing

KEYS = ("landing", "game_year")
MEASURED = tuple(c for c in FEATURES if c != "stand_code")
DISTINCT = {"games": "game_pk", "pitchers": "pitcher"}


def moments(rows: DataFrame) -> DataFrame:
    """KEYS, feature, n, centre (a whole number), offset (mean less centre), m2 of training rows; nulls left out."""
    ready = clean.training_rows(rows, keep=KEYS)
    centres = ready.groupBy(*KEYS).agg(*[F.coalesce(F.round(F.avg(c)), F.lit(0.0)).alias(f"_{c}") for c in MEASURED])
    near = ready.join(F.broadcast(centres), [*KEYS])  # a row per landing and year
    parts = [p for c in MEASURED for p in (F.count(c).alias(f"n_{c}"), F.avg(F.col(c) - F.col(f"_{c}")).alias(f"o_{c}"), F.var_pop(F.col(c) - F.col(f"_{c}")).alias(f"v_{c}"), F.first(f"_{c}").alias(f"c_{c}"))]
    each = [F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"c_{c}").alias("centre"), F.col(f"o_{c}").alias("offset"), (F.col(f"v_{c}") * F.col(f"n_{c}")).alias("m2")) for c in MEASURED]
    return near.groupBy(*KEYS).agg(*parts).select(*KEYS, F.inline(F.array(*each))).where("n > 0")


def classes(rows: DataFrame) -> DataFrame:
    """KEYS, kind ('pitch_type', 'stand'), value, n of training rows."""
    ready = clean.training_rows(rows, keep=KEYS)
    each = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("pitch_type", "stand")]
    return ready.select(*KEYS, F.inline(F.array(*each))).groupBy(*KEYS, "kind", "value").agg(F.count("*").alias("n"))


def run_values(rows: DataFrame) -> DataFrame:
    """KEYS, pitcher, pitch_type, n, cents of all rows."""
    return arsenal.with_run_value(rows).groupBy(*KEYS, "pitcher", "pitch_type").agg(F.count("*").alias("n"), F.sum("rv").alias("cents"))


def bitmaps(rows: DataFrame) -> DataFrame:
    """KEYS, name ('games', 'pitchers'), bucket, bits: the distinct ids of all rows; nulls left out."""
    ids = [F.struct(F.lit(n).alias("name"), F.col(c).cast("long").alias("id")) for n, c in DISTINCT.items()]
    each = rows.select(*KEYS, F.inline(F.array(*ids))).where("id IS NOT NULL")
    return each.groupBy(*KEYS, "name", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


KINDS: dict[str, Callable[[DataFrame], DataFrame]] = {"moments": moments, "classes": classes, "run_values": run_values, "bitmaps": bitmaps}


def _stored(spark: SparkSession, table: str, kind: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{table}/_states/{kind}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def refresh(spark: SparkSession, table: str, kinds: tuple[str, ...] = tuple(KINDS)) -> dict[str, int]:
    """Store the states of landings that have none; by kind, the number of landings read."""
    published, found = landing.manifest(spark, table), {}
    all_landings = {r[0] for r in published.select("landing").distinct().collect()}  # a row per landing
    for kind in kinds:
        stored = _stored(spark, table, kind)
        done = set() if stored is None else {r[0] for r in stored.select("landing").distinct().collect()}
        new = tuple(sorted(all_landings - done))
        found[kind] = len(new)
        if new:
            marks = spark.createDataFrame([(x,) for x in new], "landing string")
            states = KINDS[kind](landing.read_table(spark, table, landings=new))
            marks.join(states, "landing", "left").withColumn("job", F.lit(uuid.uuid4().hex)).coalesce(1).write.mode("append").parquet(f"{table}/_states/{kind}")  # some thousand rows
    return found


def read(spark: SparkSession, table: str, kind: str, years: tuple[int, ...] | None = None) -> DataFrame:
    """The stored states of published landings (``refresh`` first), of all or some years."""
    stored = _stored(spark, table, kind)
    if stored is None:
        return KINDS[kind](landing.read_table(spark, table, landings=()))
    first = stored.groupBy("landing").agg(F.min("job").alias("job"))  # a row per landing
    published = landing.manifest(spark, table).select("landing").distinct()
    rows = stored.join(F.broadcast(first), ["landing", "job"]).join(F.broadcast(published), "landing", "left_semi").where("game_year IS NOT NULL").drop("job")
    return rows if years is None else rows.where(F.col("game_year").isin(*years))


def merged_moments(states: DataFrame, *keys: str) -> DataFrame:
    """keys, feature, n, mean, m2 over all states of a feature, and of equal keys if there are any."""
    over = Window.partitionBy("feature", *keys)  # a row per landing and year
    rows = states.withColumn("ref", F.min("centre").over(over))
    rows = rows.withColumn("d", F.col("centre") - F.col("ref") + F.col("offset"))
    rows = rows.withColumn("mid", F.sum(F.col("n") * F.col("d")).over(over) / F.sum("n").over(over))
    apart = F.col("d") - F.col("mid")
    return rows.groupBy(*keys, "feature").agg(F.sum("n").alias("n"), F.first(F.col("ref") + F.col("mid")).alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"))


def label_codes(states: DataFrame) -> DataFrame:
    """kind, value, code: as ``sequences.label_codes`` has them over the training rows that the class states count."""
    return codes_of(states.select("kind", "value").distinct())


def scaler_stats(moment_states: DataFrame, class_states: DataFrame) -> DataFrame:
    """One row: as ``sequences.scaler_stats`` has it over the encoded training rows."""
    sides = class_states.where("kind = 'stand'").groupBy("value").agg(F.sum("n").alias("n"))
    codes = label_codes(class_states).where("kind = 'stand'").select(F.col("value").alias("_value"), F.col("code").cast("double").alias("code"))
    coded = sides.join(F.broadcast(codes), F.col("value").eqNullSafe(F.col("_value")))  # a row per side
    mean = F.sum(F.col("n") * F.col("code")) / F.sum("n")
    side = coded.agg(F.lit("stand_code").alias("feature"), F.sum("n").alias("n"), mean.alias("mean"), (F.sum(F.col("n") * F.col("code") * F.col("code")) - F.sum("n") * mean * mean).alias("m2"))
    whole = merged_moments(moment_states).unionByName(side)
    deviation = F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.col("n"))
    spread = whole.select("feature", "mean", F.when(deviation == 0, 1.0).otherwise(deviation).alias("std"))
    of = lambda c, part: F.max(F.when(F.col("feature") == c, F.col(part))).alias(f"{c}_{part}")
    return spread.agg(*[of(c, part) for c in FEATURES for part in ("mean", "std")])


def run_value_totals(states: DataFrame) -> DataFrame:
    """As ``arsenal.run_value_totals`` has it over all rows."""
    sums = states.groupBy("pitcher", "pitch_type").agg(F.sum("n").alias("count"), F.sum("cents").alias("rv_cents"))
    return sums.withColumn("rv_per_100", F.expr(rounded("rv_cents * 1e0 / count", 2)))


def distinct_counts(states: DataFrame, *keys: str) -> DataFrame:
    """keys, games, pitchers: exact distinct counts over all states, and by keys if there are any."""
    merged = states.groupBy(*keys, "name", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    of: list[Column] = [F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n) for n in DISTINCT]
    return merged.groupBy(*keys).agg(*of)


def table_stats(spark: SparkSession, table: str) -> DataFrame:
    """As ``ingest.table_stats`` has it: rows from the manifest, games and pitchers from the bitmaps; no data is read."""
    rows = landing.manifest(spark, table).where("n_rows > 0").groupBy("game_year").agg(F.sum("n_rows").alias("n"))
    counts = rows.join(distinct_counts(read(spark, table, "bitmaps"), "game_year"), "game_year", "left")  # a row per year
    return counts.select("game_year", "n", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in DISTINCT])
