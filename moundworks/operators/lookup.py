"""Names to players, requests to pitches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundworks.functions.constants import MIN_PITCHES

NOT_FOUND, NO_DATA, TOO_FEW, SUCCESS = "Pitcher not found", "No data for this period", "Not enough valid data", "success"


def player_candidates(requests: DataFrame, players: DataFrame) -> DataFrame:
    """Every player a request may mean: first and last word match, or else the last word alone; case is ignored."""
    parts = F.split(F.trim(F.lower("pitcher_name")), "\\s+")
    asked = requests.select("request_id", F.element_at(parts, -1).alias("_last"), F.when(F.size(parts) >= 2, parts[0]).alias("_first"))
    known = players.select("key_mlbam", "name_first", "name_last", "mlb_played_last", F.lower("name_last").alias("_last"), F.lower("name_first").alias("_f"))
    full = asked.join(known, "_last").where(F.col("_first") == F.col("_f"))
    rest = asked.join(full.select("request_id").distinct(), "request_id", "left_anti").join(known, "_last")
    columns = ("request_id", "key_mlbam", "name_first", "name_last", "mlb_played_last")
    return full.select(*columns).unionByName(rest.select(*columns))


def latest_namesake(candidates: DataFrame) -> DataFrame:
    """Of namesakes the one who played last; unknown seasons come last, ties go to the lowest id."""
    order = Window.partitionBy("request_id").orderBy(F.col("mlb_played_last").desc_nulls_last(), "key_mlbam")
    best = candidates.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return best.select("request_id", "key_mlbam", F.concat_ws(" ", "name_first", "name_last").alias("name"))


def pitches_for_requests(pitches: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pitches of each request's player within its dates (request_id, key_mlbam, start_date, end_date)."""
    return pitches_in_windows(pitches, windows(resolved)).join(resolved.select("request_id", window_key().alias("window")), "window").drop("window")


def window_key() -> Column:
    """A player and a pair of dates in one text."""
    return F.concat_ws("|", "key_mlbam", "start_date", "end_date")


def windows(resolved: DataFrame) -> DataFrame:
    """window, pitcher, start_date, end_date: requests for the same player and dates are one."""
    return resolved.select(window_key().alias("window"), F.col("key_mlbam").alias("pitcher"), "start_date", "end_date").distinct()


def pitches_in_windows(pitches: DataFrame, asked: DataFrame) -> DataFrame:
    """Pitches with each window that they lie in.  A table with game_year is read for the years asked about only."""
    if "game_year" in pitches.columns:
        least, most = asked.agg(F.min(F.year("start_date")), F.max(F.year("end_date"))).first()
        pitches = pitches.where(F.col("game_year").between(F.lit(least), F.lit(most)))
    inside = F.col("game_date").between(F.col("start_date"), F.col("end_date"))
    return pitches.join(asked, (pitches["pitcher"] == asked["pitcher"]) & inside).drop(asked["pitcher"]).drop("start_date", "end_date")


def window_counts(rows: DataFrame) -> DataFrame:
    """Per window its pitches and the clean ones among them, in one aggregation; rows has window and a flag clean."""
    return rows.groupBy("window").agg(F.count("*").alias("n_rows"), F.sum(F.col("clean").cast("long")).alias("n_clean"))


def request_status(requests: DataFrame, resolved: DataFrame, counts: DataFrame, least: int = MIN_PITCHES) -> DataFrame:
    """Each request's outcome: not found, no data, not enough, or success, in that order; counts as of ``window_counts``."""
    joined = requests.select("request_id").join(resolved.select("request_id", "key_mlbam", window_key().alias("window")), "request_id", "left").join(counts, "window", "left")
    joined = joined.na.fill(0, ["n_rows", "n_clean"])
    status = F.when(F.col("key_mlbam").isNull(), NOT_FOUND).when(F.col("n_rows") == 0, NO_DATA).when(F.col("n_clean") < least, TOO_FEW).otherwise(SUCCESS)
    return joined.select("request_id", "n_rows", "n_clean", status.alias("status"))
