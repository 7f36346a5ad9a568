"""Rows for five-pitch windows kept by game, so that a new season is indexed without reading the old ones.

A row's place is its game's offset plus its place within the game, and only the first ``SEQUENCE`` rows of a game have
windows that reach into games before it.  So ``refresh`` reads the landings that are new and stores, for each of their training
rows, the place in its game and the values; a game's first and last rows lie in a folder of their own.  ``windows`` sums the
offsets over the list of games, looks back within a game for the rows that are asked for, and makes the windows at the seams
from those first and last rows alone, some ten a game.  Values that lie before a row are not stored with it: written five
times over they took most of a refresh.  A season's games may come before, between or after those that are there: nothing stored
changes, whatever lands.

Values are stored as they are; ``dataset`` scales and encodes them on read, as encoders change with every landing
(``states`` keeps them).  A game that comes in several landings is made anew from those landings, and the newest making of a
game counts.  A job publishes its rows by one line at its end; without it they are never read.  Rows without a game have no
place and take none; ties within a game are in any order.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundworks.functions.constants import FEATURES, SEQUENCE, TRAINING_LIMIT
from moundworks.operators import clean, sequences
from moundworks.sources import landing
from moundworks.sources.shared import spread

RAW = {"release_speed": "double", "plate_x": "double", "plate_z": "double", "balls": "int", "strikes": "int", "stand": "string"}
BEFORE = {f"{c}_{i}": (c, SEQUENCE - i + 1) for i in range(1, SEQUENCE + 1) for c in RAW}
JOBS = "job string, generation long, landings array<string>"
SCHEMA = "game_pk long, own int, n int, landings array<string>, pitch_type string, " + ", ".join(f"{c} {t}" for c, t in RAW.items()) + ", job string, edge int"


def _jobs(spark: SparkSession, table: str) -> DataFrame:
    """A row per job that has finished."""
    try:
        return spark.read.schema(JOBS).parquet(f"{table}/_windows/jobs")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], JOBS)


def _stored(spark: SparkSession, table: str) -> DataFrame:
    """All rows of finished jobs, with the job's generation."""
    jobs = _jobs(spark, table).select("job", "generation")
    folder = f"{table}/_windows/rows"
    paths = [f"{folder}/job={r['job']}" for r in jobs.collect()]  # a row per landing at most
    if not paths:
        return spark.createDataFrame([], f"{SCHEMA}, generation long")
    return spark.read.schema(SCHEMA).option("basePath", folder).parquet(*paths).join(F.broadcast(jobs), "job")


def _games(rows: DataFrame) -> DataFrame:
    """game_pk, n, landings, job: the newest making of each game."""
    newest = Window.partitionBy("game_pk").orderBy(F.desc("generation"), "job")  # a row per making
    made = rows.where("edge = 1 AND own = 0").withColumn("_r", F.row_number().over(newest))
    return made.where("_r = 1").select("game_pk", "n", "landings", "job")


def _published(spark: SparkSession, table: str) -> set[str]:
    return {r[0] for r in landing.manifest(spark, table).select("landing").distinct().collect()}  # a row per landing


def refresh(spark: SparkSession, table: str) -> int:
    """Store the rows of landings that no job has read; the number of those landings."""
    published, done = _published(spark, table), {x for r in _jobs(spark, table).collect() for x in r["landings"]}
    new = published - done
    if not new:
        return 0
    read = lambda which: clean.training_rows(landing.read_table(spark, table, landings=tuple(sorted(which))), keep=("landing",))
    rows = whole = read(new)
    if done:
        known, gone = _games(_stored(spark, table)), F.array(*[F.lit(x) for x in sorted(done - published)]).cast("array<string>")
        again = known.join(rows.select("game_pk").distinct(), "game_pk", "left_semi").unionByName(known.where(F.arrays_overlap("landings", gone)))
        old = {r[0] for r in again.select(F.explode("landings")).distinct().collect()} & published - new
        if old:  # games that new rows belong to as well
            more = read(old)
            whole = rows.unionByName(more)
            rows = rows.unionByName(more.join(again.select("game_pk"), "game_pk", "left_semi"))
    game = Window.partitionBy("game_pk")  # a game's pitches
    order = game.orderBy("at_bat_number", "pitch_number")
    dealt = spread(rows.where("game_pk IS NOT NULL"), "game_pk", of=whole)
    numbered = dealt.select("*", (F.row_number().over(order) - 1).alias("own"), F.count("*").over(game).cast("int").alias("n"), F.collect_set("landing").over(game).alias("_landings"))
    edge = ((F.col("own") < SEQUENCE) | (F.col("own") >= F.col("n") - SEQUENCE)).cast("int").alias("edge")
    job = f"job-{uuid.uuid4().hex}"
    made = numbered.select("game_pk", "own", "n", F.when(F.col("own") == 0, F.col("_landings")).alias("landings"), "pitch_type", *RAW, edge)
    made.write.partitionBy("edge").parquet(f"{table}/_windows/rows/job={job}")
    spark.createDataFrame([(job, len(published | done), sorted(new))], JOBS).coalesce(1).write.mode("append").parquet(f"{table}/_windows/jobs")
    return len(new)


def windows(spark: SparkSession, table: str, limit: int | None = TRAINING_LIMIT, boundary: str = "global") -> DataFrame:
    """idx, label (a pitch type) and <column>_1 .. <column>_5 of RAW, as ``sequences.windows`` has them over all training
    rows that ``refresh`` has seen; boundary: 'global', or 'game' for windows that lie within one."""
    if boundary not in ("global", "game"):
        raise ValueError(f"windows are stored for 'global' and 'game', not for {boundary!r}")
    rows = _stored(spark, table)
    listed = F.array(*[F.lit(x) for x in sorted(_published(spark, table))]).cast("array<string>")
    ends, up_to = F.least("n", F.lit(2 * SEQUENCE)), Window.orderBy("game_pk").rowsBetween(Window.unboundedPreceding, 0)  # a row per game
    games = _games(rows).where(F.size(F.array_except("landings", listed)) == 0)
    places = games.select("game_pk", "job", "n", (F.sum("n").over(up_to) - F.col("n")).alias("_offset"), ends.alias("_ends"), (F.sum(ends).over(up_to) - ends).alias("_seam"))
    if limit is None:
        rows = spread(rows, "game_pk", "job")
    else:
        places = places.where(F.col("_offset") < limit)
        last = places.agg(F.max("game_pk")).first()[0]
        rows, places = rows.where(F.col("game_pk") <= F.lit(last)), F.broadcast(places)  # limit games at most; files are in the order of games
    placed = rows.drop("n", "landings", "generation").join(places, ["game_pk", "job"]).withColumn("idx", F.col("_offset") + F.col("own"))
    placed = placed if limit is None else placed.where(F.col("idx") < limit)
    order = Window.partitionBy("game_pk", "job").orderBy("own")  # a game's pitches, of its one making that counts
    before: list[Column] = [F.lag(c, k).over(order).alias(name) for name, (c, k) in BEFORE.items()]
    within = placed.select("idx", "own", F.col("pitch_type").alias("label"), *before).where(F.col("own") >= SEQUENCE).drop("own")
    if boundary == "game":
        return within
    at = F.col("_seam") + F.when(F.col("own") < SEQUENCE, F.col("own")).otherwise(F.col("own") - F.col("n") + F.col("_ends"))
    seams = placed.where("edge = 1").select(at.alias("idx"), F.struct("idx", "own", "pitch_type").alias("row"), *RAW)
    across = sequences.windows(seams, tuple(RAW), "row", limit=limit).where(F.col("label.own") < SEQUENCE)
    return within.unionByName(across.select("label.idx", F.col("label.pitch_type").alias("label"), *BEFORE))


def dataset(made: DataFrame, codes: DataFrame, stats: DataFrame) -> DataFrame:
    """Windows with codes for labels and sides and with scaled features: the rows of ``sequences.sequence_dataset``."""
    types = codes.where("kind = 'pitch_type'").select(F.col("value").alias("label"), F.col("code").alias("_label"))
    entry = F.when(F.col("value").isNotNull(), F.struct("value", "code"))
    sides = codes.where("kind = 'stand'").agg(F.map_from_entries(F.collect_list(entry)).alias("_sides"), F.max(F.when(F.col("value").isNull(), F.col("code"))).alias("_none"))  # a row per side
    rows = made.join(F.broadcast(types), "label").crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(sides))  # classes; one row; one row

    def value(c: str, i: int) -> Column:
        side = F.col(f"stand_{i}")
        x = F.coalesce(F.try_element_at("_sides", side), F.when(side.isNull(), F.col("_none"))) if c == "stand_code" else F.col(f"{c}_{i}")
        return ((x - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(f"{c}_{i}")

    return rows.select("idx", F.col("_label").alias("label"), *[value(c, i) for i in range(1, SEQUENCE + 1) for c in FEATURES])
