"""The matchup report for all requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.functions.constants import CLEAN_COLUMNS
from moundworks.operators import arsenal, clean, cube, lookup
from moundworks.sources.shared import materialise

#: What a report needs of a pitch.
COLUMNS = ("game_pk", "at_bat_number", "pitch_number", "pitch_type", *CLEAN_COLUMNS, "release_pos_x", "release_pos_z", "release_extension", "events", "description")
#: The JSON of a report.
SCHEMA = "name string, id long, period struct<start:date,end:date>, arsenal map<string,struct<stats:struct<count:long,percentage:double,{}>>>, locations array<struct<pitch_type:string,plate_x:double,plate_z:double,pfx_x:double,pfx_z:double,release_speed:double>>".format(",".join(f"{c}:double" for c in arsenal.MEASURES))


def resolve(requests: DataFrame, players: DataFrame, as_of: str) -> DataFrame:
    """Requests with their player and dates; those without a player are left out."""
    who = lookup.latest_namesake(lookup.player_candidates(requests, players))
    return clean.date_window(requests, as_of).select("request_id", "start_date", "end_date").join(who, "request_id")


def report(pitches: DataFrame, requests: DataFrame, players: DataFrame, as_of: str, days: DataFrame | None = None) -> DataFrame:
    """request_id, status and, on success, the pitcher with arsenal and sampled locations as JSON text.

    Counts and arsenals come from the prefix-sum cube, locations from samples by dyadic blocks (see ``operators.cube``), so
    no window is joined with its pitches.  days: a stored table of ``cube.daily``, else it is made from the pitches.
    """
    resolved = materialise(resolve(requests, players, as_of), "resolved")
    windows = materialise(lookup.windows(resolved), "windows")
    wanted = materialise(cube.near_windows(pitches.select("pitcher", "game_date", *COLUMNS), windows), "wanted")  # each pitch once, if at all
    days = cube.daily(wanted) if days is None else cube.merged(cube.near_windows(days, windows))
    sums = materialise(cube.window_sums(days, windows), "sums")
    status = lookup.request_status(requests, resolved, cube.window_counts(sums))
    stats = [c for c in arsenal.MEASURES]
    entry = F.struct("pitch_type", F.struct(F.struct("count", "percentage", *stats).alias("stats")).alias("entry"))
    by_type = cube.window_arsenal(sums).groupBy("window").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("arsenal"))  # twelve types at most
    spots = F.struct("pitch_type", "plate_x", "plate_z", "pfx_x", "pfx_z", "release_speed")
    samples = cube.window_samples(wanted.where(clean.is_valid()), windows, ("pitch_type", *CLEAN_COLUMNS))
    located = clean.locations(samples).groupBy("window").agg(F.array_sort(F.collect_list(spots)).alias("locations"))  # a thousand at most
    asked = resolved.withColumn("window", lookup.window_key()).join(by_type, "window", "left").join(located, "window", "left")
    whole = status.join(asked, "request_id", "left")
    pitcher = F.struct(F.col("name"), F.col("key_mlbam").alias("id"), F.struct(F.col("start_date").alias("start"), F.col("end_date").alias("end")).alias("period"), "arsenal", "locations")
    return whole.select("request_id", "status", F.when(F.col("status") == lookup.SUCCESS, F.to_json(pitcher)).alias("pitcher"))


def flattened(reports: DataFrame) -> DataFrame:
    """A row per request and pitch type (one row without a type where there is no arsenal), read back from the JSON.

    locations_md5 is a digest of the locations' values, in 64ths.
    """
    rows = reports.select("request_id", "status", F.from_json("pitcher", SCHEMA).alias("p"))
    spots = F.size("p.locations")
    place = lambda x: F.concat_ws(":", x["pitch_type"], *[F.floor(x[c] * 64.0 + 0.5).cast("long").cast("string") for c in ("plate_x", "plate_z", "pfx_x", "pfx_z", "release_speed")])
    digest = F.md5(F.array_join(F.array_sort(F.transform("p.locations", place)), ","))
    rows = rows.select("request_id", "status", "p.name", "p.id", F.col("p.period.start").cast("string").alias("start_date"), F.col("p.period.end").cast("string").alias("end_date"), F.when(spots >= 0, spots).cast("long").alias("n_locations"), digest.alias("locations_md5"), F.explode_outer("p.arsenal").alias("pitch_type", "entry"))
    return rows.select(*rows.columns[:-1], *[F.col(f"entry.stats.{c}").alias(c) for c in ("count", "percentage", *arsenal.MEASURES)])
