"""The registered queries over the pitch world, each with its SQL where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.functions import constants as C
from moundworks.functions import expressions as E
from moundworks.functions.expressions import rounded
from moundworks.operators import arsenal, backoff, bundles, charts, clean, cube, increments, kinematics, lookup, models, outcomes, recurrent, scoring, sequences, states
from moundworks.plans import report
from moundworks.sources import fixtures, ingest, landing
from moundworks.sources.shared import materialise, shared_base, shared_folder, spread

World = dict[str, DataFrame]


def _weight(column: str) -> str:
    """The checks' own table of run values in hundredths, written out apart from the library's."""
    return f"""CASE WHEN {column} IN ('ball', 'blocked_ball') THEN 6 WHEN {column} = 'called_strike' THEN -6 WHEN {column} = 'swinging_strike' THEN -12
    WHEN {column} = 'foul' THEN -4 WHEN {column} = 'hit_into_play' THEN 0 WHEN {column} = 'single' THEN 48 WHEN {column} = 'double' THEN 77 WHEN {column} = 'triple' THEN 105
    WHEN {column} = 'home_run' THEN 140 WHEN {column} = 'walk' THEN 32 WHEN {column} = 'hit_by_pitch' THEN 34 WHEN {column} IN ('strikeout', 'field_out', 'force_out') THEN -27
    WHEN {column} = 'grounded_into_double_play' THEN -45 END"""


_RUN_VALUE = f"CAST(coalesce({_weight('events')}, {_weight('description')}, 0) AS BIGINT)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KEY = ("game_pk", "at_bat_number", "pitch_number")
KEYS = ", ".join(KEY)
_CLEAN = f"SELECT * FROM pitches WHERE {E.VALID} AND " + " AND ".join(f"{c} IS NOT NULL" for c in C.CLEAN_COLUMNS)
_GROUPS = f"""SELECT *, CAST(sum(count) OVER (PARTITION BY pitcher) AS BIGINT) AS total FROM (
  SELECT pitcher, pitch_type, count(*) AS count, CAST(sum(rv) AS BIGINT) AS rv, {", ".join(f"avg({c}) AS {a}" for a, c in arsenal.AVERAGES.items())}
  FROM (SELECT *, {_RUN_VALUE} AS rv FROM clean) GROUP BY pitcher, pitch_type)"""
_ARSENAL = f"""SELECT pitcher, pitch_type, count, {rounded("count * 100e0 / total", 1)} AS percentage, {", ".join(f"{rounded(e, n)} AS {c}" for c, (e, n) in arsenal.MEASURES.items())}
  FROM groups WHERE total >= {C.MIN_PITCHES} AND count >= {C.MIN_PER_TYPE}"""
_ASKED = r"""SELECT request_id, parts[len(parts)] AS lname, CASE WHEN len(parts) >= 2 THEN parts[1] END AS fname
  FROM (SELECT request_id, string_split_regex(trim(lower(pitcher_name)), '\s+') AS parts FROM matchup_requests)"""
_CANDIDATES = """SELECT request_id, p.* FROM asked JOIN players p ON lower(name_last) = lname AND lower(name_first) = fname
  UNION ALL SELECT request_id, p.* FROM asked JOIN players p ON lower(name_last) = lname
  WHERE request_id NOT IN (SELECT request_id FROM asked JOIN players ON lower(name_last) = lname AND lower(name_first) = fname)"""
_RESOLVED = f"""SELECT request_id, key_mlbam, name_first || ' ' || name_last AS name, coalesce(end_date, DATE '{fixtures.AS_OF}') AS end_date,
    coalesce(start_date, coalesce(end_date, DATE '{fixtures.AS_OF}') - 365) AS start_date
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY mlb_played_last DESC NULLS LAST, key_mlbam) AS r FROM candidates) JOIN matchup_requests USING (request_id) WHERE r = 1"""
_ASKED_ROWS = "SELECT p.*, request_id FROM pitches p JOIN resolved ON pitcher = key_mlbam AND game_date BETWEEN start_date AND end_date"
_TRAINING = f"""SELECT {KEYS}, pitcher, pitch_type, release_speed, plate_x, plate_z, balls, strikes, stand FROM pitches
  WHERE game_date >= DATE '{C.TRAINING_FLOOR}' AND pitch_type IS NOT NULL AND release_speed IS NOT NULL AND plate_x IS NOT NULL"""
_CODES = """SELECT kind, value, CAST(row_number() OVER (PARTITION BY kind ORDER BY value NULLS LAST) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT 'pitch_type' AS kind, pitch_type AS value FROM training UNION ALL SELECT DISTINCT 'stand', stand FROM training)"""
_CODED = """SELECT t.*, a.code AS label, b.code AS stand_code FROM training t JOIN codes a ON a.kind = 'pitch_type' AND a.value = t.pitch_type
  JOIN codes b ON b.kind = 'stand' AND b.value IS NOT DISTINCT FROM t.stand"""
_STATS = "SELECT " + ", ".join(f"avg({c}) AS {c}_mean, CASE WHEN stddev_pop({c}) = 0 THEN 1e0 ELSE stddev_pop({c}) END AS {c}_std" for c in C.FEATURES) + " FROM coded"
_TOP = f"""SELECT pitcher, batter_stand, balls, strikes, CAST(r AS INTEGER) AS rank, pitch_type, {rounded("probability * 100e0", 1)} AS percent
  FROM (SELECT *, row_number() OVER (PARTITION BY pitcher, batter_stand, balls, strikes ORDER BY probability DESC, code) AS r FROM class_probabilities WHERE probability > {C.MIN_PROBABILITY}) WHERE r <= {C.TOP_K}"""
_KEPT = """SELECT t.* FROM top_k t WHERE pitch_type NOT IN ('EP', 'PO') AND EXISTS (SELECT 1 FROM arsenal a WHERE a.pitcher = t.pitcher AND a.pitch_type = t.pitch_type)"""
_INPUTS = "SELECT * REPLACE (" + ", ".join(f"CASE WHEN isfinite({c}) THEN {c} ELSE {d}e0 END AS {c}" for c, d in E.INPUT_DEFAULTS.items()) + ") FROM "


def _flight(source: str, more: str = "") -> str:
    n = kinematics.NAMES
    return f"SELECT *, {E.FLIGHT.format(**n)} AS flight, {E.ACCEL_X.format(**n)} AS ax, {E.ACCEL_Z.format(**n)} AS az{more} FROM {source}"


def _solved(source: str) -> str:
    n = kinematics.NAMES
    return f"SELECT *, {E.TO_PLATE_VX.format(**n)} AS vx0, {E.TO_PLATE_VZ.format(**n)} AS vz0 FROM ({_flight(source)})"


def _at(shape: dict[str, str], i: str, suffix: str = "") -> str:
    return ", ".join(f"{v.format(**kinematics.NAMES, t=f'({i} / {kinematics.STEPS}e0 * flight)')} AS {k}{suffix}" for k, v in shape.items())


_INCHES = "(SELECT * REPLACE (pfx_x * 12e0 AS pfx_x, pfx_z * 12e0 AS pfx_z) FROM clean)"
_STEPS = f"(SELECT UNNEST(range(0, {kinematics.STEPS + 1})) AS i)"
_ARSENAL_INPUT = "(SELECT *, avg_velocity AS release_speed FROM arsenal)"

#: Parts of checks, each after those that it uses.
PARTS = fixtures.VIEWS | {
    "clean": _CLEAN, "groups": _GROUPS, "arsenal": _ARSENAL, "asked": _ASKED, "candidates": _CANDIDATES, "resolved": _RESOLVED, "asked_rows": _ASKED_ROWS,
    "training": _TRAINING, "codes": _CODES, "coded": _CODED, "stats": _STATS, "outcomes": "", "top_k": _TOP, "kept": _KEPT,
}
PARTS["outcomes"] = """SELECT pitcher, pitch_type, stand, count(*) AS sample_size, avg(release_speed) AS speed,
  count(*) FILTER (WHERE description LIKE 'swinging_strike%') AS whiffs,
  count(*) FILTER (WHERE description LIKE 'swinging_strike%' OR description LIKE 'foul%' OR description = 'hit_into_play') AS swings,
  count(*) FILTER (WHERE strikes = 2) AS two_strikes,
  count(*) FILTER (WHERE strikes = 2 AND events LIKE 'strikeout%') AS strikeouts,
  count(*) FILTER (WHERE description = 'hit_into_play' AND launch_speed IS NOT NULL) AS in_play,
  count(*) FILTER (WHERE description = 'hit_into_play' AND launch_speed >= 95) AS hard_hit
FROM pitches GROUP BY pitcher, pitch_type, stand"""
USES = {
    "matchup_requests": ("players",), "contexts": ("pitches",), "class_probabilities": ("contexts",), "clean": ("pitches",), "groups": ("clean",), "arsenal": ("groups",),
    "asked": ("matchup_requests",), "candidates": ("asked",), "resolved": ("candidates",), "asked_rows": ("pitches", "resolved"), "training": ("pitches",), "codes": ("training",),
    "coded": ("codes",), "stats": ("coded",), "outcomes": ("pitches",), "top_k": ("class_probabilities",), "kept": ("top_k", "arsenal"),
}


def with_parts(body: str, *parts: str) -> str:
    needed, left = set(), list(parts)
    while left:
        name = left.pop()
        if name not in needed:
            needed.add(name)
            left += USES.get(name, ())
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in PARTS.items() if k in needed) + f"\n{body}"


def query(name: str, sql: str | None = None, *parts: str) -> Callable:
    """Register a function of the pitch world; sql checks it, over the named parts."""

    def register(f: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(fixtures.world(spark, sf_dir))
        if sql:
            ORACLES[name] = with_parts(sql, *parts)
        return f

    return register


def clean_rows(w: World) -> DataFrame:
    return clean.valid_pitches(w["pitches"])


def in_inches(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"pfx_x": F.col("pfx_x") * 12.0, "pfx_z": F.col("pfx_z") * 12.0})


# Sources and sinks


@query("season_window", "SELECT year(game_date) AS game_year, month(game_date) AS game_month, count(*) AS n FROM pitches WHERE month(game_date) BETWEEN 3 AND 11 GROUP BY 1, 2", "pitches")
def season_window(w: World) -> DataFrame:
    rows = ingest.season_window(w["pitches"]).groupBy("game_year", F.month("game_date").alias("game_month")).agg(F.count("*").alias("n"))
    return rows.select(F.col("game_year").cast("long"), F.col("game_month").cast("long"), "n")


@query("ingest_incremental", f"SELECT {KEYS}, year(game_date) AS game_year FROM pitches WHERE month(game_date) BETWEEN 3 AND 11 AND year(game_date) NOT IN (SELECT year(game_date) FROM pitches WHERE year(game_date) <= 2022)", "pitches")
def ingest_incremental(w: World) -> DataFrame:
    new = ingest.season_window(w["pitches"])
    return ingest.not_landed(new, new.where("game_year <= 2022")).select(*KEY, F.col("game_year").cast("long"))


_YEARS = {2021: "* EXCLUDE (launch_speed)", 2022: "*, inning + 1 AS extra", 2023: "*", 2024: "*"}


@query("ingest_union_by_name", f"SELECT {KEYS}, launch_speed, extra FROM (" + " UNION ALL BY NAME ".join(f"SELECT {c} FROM pitches WHERE year(game_date) = {y}" for y, c in _YEARS.items()) + ")", "pitches")
def ingest_union_by_name(w: World) -> DataFrame:
    """Yearly CSV folders with columns absent, added and in another order, written and read back."""
    spark, folder = w["pitches"].sparkSession, shared_folder(w["pitches"].sparkSession, "csv")
    by_year = {y: fixtures.of_year(w, y) for y in _YEARS}
    by_year[2021] = by_year[2021].drop("launch_speed")
    by_year[2022] = by_year[2022].withColumn("extra", F.col("inning") + 1)
    by_year[2023] = by_year[2023].select(*reversed(w["pitches"].columns))
    for year, rows in by_year.items():
        rows.write.option("header", True).csv(f"{folder}/{year}")
    return ingest.read_csvs(spark, [f"{folder}/{y}" for y in by_year]).select(*KEY, "launch_speed", F.col("extra").cast("int"))


_LANDED = f"""SELECT year(game_date) AS game_year, CASE WHEN year(game_date) = 2023 THEN 'failed' ELSE 'landed' END AS first_status, CASE WHEN year(game_date) = 2023 THEN 'landed' ELSE 'skipped' END AS second_status,
  count(*) AS n, count(DISTINCT ({KEYS})) AS n_pitches FROM pitches WHERE month(game_date) BETWEEN 3 AND 11 GROUP BY 1"""


@query("land_years", _LANDED, "pitches")
def land_years(w: World) -> DataFrame:
    """Yearly CSV files landed twice; in the first run the tasks of 2023 fail half-way through its games."""
    spark, folder = w["pitches"].sparkSession, shared_folder(w["pitches"].sparkSession, "landing")
    w["pitches"].withColumn("game_year", F.year("game_date")).write.option("header", True).partitionBy("game_year").csv(f"{folder}/csv")
    files = {y: [f"{folder}/csv/game_year={y}"] for y in _YEARS}
    half = w["pitches"].where(F.year("game_date") == 2023).agg(F.avg("game_pk")).first()[0] or 0.0
    bad = (F.col("game_year") == 2023) & (F.col("game_pk") > half)
    fails = lambda rows: rows.withColumn("game_pk", F.when(bad, F.raise_error(F.lit("the source broke off")).cast("long")).otherwise(F.col("game_pk")))
    runs = [landing.land_years(spark, files, f"{folder}/table", check) for check in (fails, None)]
    known = F.when(F.col("status").isin("landed", "skipped", "empty"), F.col("status")).otherwise("failed")
    first, second = (r.select("game_year", known.alias(n)) for r, n in zip(runs, ("first_status", "second_status"), strict=True))
    table = spread(landing.read_table(spark, f"{folder}/table"), "game_year", *KEY).groupBy("game_year").agg(F.count("*").alias("n"), F.countDistinct(*KEY).alias("n_pitches"))
    return table.join(first, "game_year").join(second, "game_year").select(F.col("game_year").cast("long"), "first_status", "second_status", "n", "n_pitches")


@query("build_table", f"SELECT {KEYS}, pitcher, year(game_date) AS game_year FROM pitches", "pitches")
def build_table(w: World) -> DataFrame:
    path = shared_folder(w["pitches"].sparkSession, "pitches")
    ingest.write_table(w["pitches"], path)
    return w["pitches"].sparkSession.read.parquet(path).select(*KEY, "pitcher", F.col("game_year").cast("long"))


@query("table_stats", "SELECT year(game_date) AS game_year, count(*) AS n, count(DISTINCT game_pk) AS games, count(DISTINCT pitcher) AS pitchers FROM pitches GROUP BY 1", "pitches")
def table_stats(w: World) -> DataFrame:
    return ingest.table_stats(w["pitches"].withColumn("game_year", F.year("game_date").cast("long")))


# Projections and filters


@query("valid_pitches", f"SELECT {KEYS}, pitch_type, release_speed, pfx_x, pfx_z, plate_x, plate_z FROM clean", "clean")
def valid_pitches(w: World) -> DataFrame:
    return clean_rows(w).select(*KEY, "pitch_type", *C.CLEAN_COLUMNS)


@query("date_window", f"SELECT request_id, CAST(coalesce(start_date, coalesce(end_date, DATE '{fixtures.AS_OF}') - 365) AS VARCHAR) AS start_date, CAST(coalesce(end_date, DATE '{fixtures.AS_OF}') AS VARCHAR) AS end_date FROM matchup_requests", "matchup_requests")
def date_window(w: World) -> DataFrame:
    return clean.date_window(w["matchup_requests"], fixtures.AS_OF).select("request_id", F.col("start_date").cast("string"), F.col("end_date").cast("string"))


@query("training_rows", "SELECT * FROM training", "training")
def training_rows(w: World) -> DataFrame:
    return clean.training_rows(w["pitches"])


@query("min_sample_guard", f"SELECT pitcher, count(*) AS n, count(*) >= {C.MIN_PITCHES} AS accepted FROM clean GROUP BY pitcher", "clean")
def min_sample_guard(w: World) -> DataFrame:
    return clean.min_sample_guard(clean_rows(w))


@query("noise_filter", f"SELECT pitcher, pitch_type, count, {rounded('count * 100e0 / total', 1)} AS percentage FROM groups WHERE count >= {C.MIN_PER_TYPE}", "groups")
def noise_filter(w: World) -> DataFrame:
    return arsenal.noise_filter(clean_rows(w))


@query("locations", f"SELECT {KEYS}, pitch_type, coalesce(plate_x, 0e0) AS plate_x, coalesce(plate_z, 0e0) AS plate_z, coalesce(pfx_x, 0e0) * 12e0 AS pfx_x, coalesce(pfx_z, 0e0) * 12e0 AS pfx_z, coalesce(release_speed, 0e0) AS release_speed FROM pitches", "pitches")
def locations(w: World) -> DataFrame:
    return clean.locations(w["pitches"]).select(*KEY, "pitch_type", *C.CLEAN_COLUMNS)


@query("movement_scatter", f"SELECT {KEYS}, pitch_type, {rounded('-pfx_x', 1)} AS x, {rounded('pfx_z', 1)} AS z FROM clean WHERE pfx_x IS NOT NULL AND pfx_z IS NOT NULL", "clean")
def movement_scatter(w: World) -> DataFrame:
    return clean.movement_scatter(clean_rows(w)).select(*KEY, "pitch_type", "x", "z")


@query("active_types", f"SELECT {KEYS}, pitch_type, plate_x, plate_z FROM pitches WHERE pitch_type IN ('FF', 'SL') AND plate_x IS NOT NULL AND plate_z IS NOT NULL", "pitches")
def active_types(w: World) -> DataFrame:
    return clean.active_types(w["pitches"], ("FF", "SL")).select(*KEY, "pitch_type", "plate_x", "plate_z")


_STATUS = f"""SELECT request_id, n_rows, n_clean, CASE WHEN key_mlbam IS NULL THEN '{lookup.NOT_FOUND}' WHEN n_rows = 0 THEN '{lookup.NO_DATA}' WHEN n_clean < {C.MIN_PITCHES} THEN '{lookup.TOO_FEW}' ELSE '{lookup.SUCCESS}' END AS status
FROM (SELECT q.request_id, any_value(r.key_mlbam) AS key_mlbam, count(a.pitcher) AS n_rows, count(a.pitcher) FILTER (WHERE {E.VALID} AND release_speed IS NOT NULL AND pfx_x IS NOT NULL AND pfx_z IS NOT NULL AND plate_x IS NOT NULL AND plate_z IS NOT NULL) AS n_clean
  FROM matchup_requests q LEFT JOIN resolved r ON q.request_id = r.request_id LEFT JOIN asked_rows a ON q.request_id = a.request_id GROUP BY q.request_id)"""


@query("request_status", _STATUS, "asked_rows")
def request_status(w: World) -> DataFrame:
    resolved = report.resolve(w["matchup_requests"], w["players"], fixtures.AS_OF)
    resolved = materialise(resolved, "resolved")
    windows = lookup.windows(resolved)
    sums = cube.window_sums(cube.daily_counts(cube.near_windows(w["pitches"], windows)), windows, (cube.REST,))
    return lookup.request_status(w["matchup_requests"], resolved, sums.drop("pitch_type"))


# Joins


@query("player_lookup", "SELECT request_id, key_mlbam, name_first, name_last, mlb_played_last FROM candidates", "candidates")
def player_lookup(w: World) -> DataFrame:
    return lookup.player_candidates(w["matchup_requests"], w["players"])


@query("latest_namesake", "SELECT request_id, key_mlbam, name FROM resolved", "resolved")
def latest_namesake(w: World) -> DataFrame:
    return lookup.latest_namesake(lookup.player_candidates(w["matchup_requests"], w["players"]))


@query("pitches_for_requests", f"SELECT request_id, {KEYS}, pitcher FROM asked_rows", "asked_rows")
def pitches_for_requests(w: World) -> DataFrame:
    return lookup.pitches_for_requests(w["pitches"], report.resolve(w["matchup_requests"], w["players"], fixtures.AS_OF)).select("request_id", *KEY, "pitcher")


@query("run_value", f"SELECT {KEYS}, events, description, {_RUN_VALUE} AS rv FROM pitches", "pitches")
def run_value(w: World) -> DataFrame:
    return arsenal.with_run_value(w["pitches"]).select(*KEY, "events", "description", "rv")


@query("pitch_names", f"SELECT {KEYS}, pitch_type, {E.PITCH_NAME} AS pitch_name FROM pitches", "pitches")
def pitch_names(w: World) -> DataFrame:
    return arsenal.with_names(w["pitches"]).select(*KEY, "pitch_type", "pitch_name")


@query("predictions_in_arsenal", "SELECT * FROM kept", "kept")
def predictions_in_arsenal(w: World) -> DataFrame:
    found = scoring.in_arsenal(scoring.top_predictions(w["class_probabilities"]), arsenal.arsenal(clean_rows(w)))
    return found.select(*scoring.CONTEXT_KEYS, "rank", "pitch_type", "percent")


@query("prediction_fallback", """SELECT * FROM kept UNION ALL
SELECT c.pitcher, c.batter_stand, c.balls, c.strikes, 1, f.pitch_type, 99.9e0 FROM contexts c JOIN (SELECT pitcher, min(pitch_type) AS pitch_type FROM arsenal GROUP BY pitcher) f ON c.pitcher = f.pitcher
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.pitcher = c.pitcher AND k.batter_stand = c.batter_stand AND k.balls = c.balls AND k.strikes = c.strikes)""", "kept")
def prediction_fallback(w: World) -> DataFrame:
    return scoring.with_fallback(w["contexts"], scoring.top_predictions(w["class_probabilities"]), arsenal.arsenal(clean_rows(w)))


def simulation_requests(w: World) -> DataFrame:
    types = F.explode(F.array(*map(F.lit, C.VALID_ARSENAL))).alias("pitch_type")
    return w["contexts"].select("pitcher", "batter_stand").distinct().select("pitcher", types, "batter_stand")


_SIMULATIONS = "(SELECT DISTINCT c.pitcher, t.pitch_type, c.batter_stand FROM contexts c, (VALUES " + ", ".join(f"('{t}')" for t in C.VALID_ARSENAL) + ") AS t(pitch_type))"


@query("sim_defaults", f"SELECT pitcher, pitch_type, batter_stand, {E.SIM_SPEED} AS release_speed, {E.SIM_BREAK} AS pfx_z FROM {_SIMULATIONS}", "contexts")
def sim_defaults(w: World) -> DataFrame:
    return kinematics.sim_defaults(simulation_requests(w))


# The report


_SAMPLED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {charts.SAMPLE_ORDER}, {KEYS}) AS r FROM asked_rows
  WHERE {E.VALID} AND {" AND ".join(f"{c} IS NOT NULL" for c in C.CLEAN_COLUMNS)}) WHERE r <= {C.MAX_LOCATIONS}"""


@query("report_json", f"""SELECT q.request_id, q.status, CASE WHEN success THEN r.name END AS name, CASE WHEN success THEN r.key_mlbam END AS id,
  CASE WHEN success THEN CAST(r.start_date AS VARCHAR) END AS start_date, CASE WHEN success THEN CAST(r.end_date AS VARCHAR) END AS end_date, CASE WHEN success THEN least(n_clean, {C.MAX_LOCATIONS}) END AS n_locations,
  l.locations_md5, a.* EXCLUDE (request_id) FROM (SELECT *, status = '{lookup.SUCCESS}' AS success FROM ({_STATUS})) q LEFT JOIN resolved r ON q.request_id = r.request_id
LEFT JOIN (SELECT request_id, pitch_type, count, {rounded("count * 100e0 / total", 1)} AS percentage, {", ".join(f"{rounded(e, n)} AS {c}" for c, (e, n) in arsenal.MEASURES.items())} FROM (
  SELECT request_id, pitch_type, count(*) AS count, CAST(sum(sum(1)) OVER (PARTITION BY request_id) AS BIGINT) AS total, CAST(sum(rv) AS BIGINT) AS rv, {", ".join(f"avg({c}) AS {a}" for a, c in arsenal.AVERAGES.items())}
  FROM (SELECT *, {_RUN_VALUE} AS rv FROM asked_rows WHERE {E.VALID} AND {" AND ".join(f"{c} IS NOT NULL" for c in C.CLEAN_COLUMNS)}) GROUP BY request_id, pitch_type)
  WHERE total >= {C.MIN_PITCHES} AND count >= {C.MIN_PER_TYPE}) a ON q.request_id = a.request_id
LEFT JOIN (SELECT request_id, md5(string_agg(place, ',' ORDER BY place)) AS locations_md5 FROM (
  SELECT request_id, concat_ws(':', pitch_type, {", ".join(f"CAST(floor({c} * {f} + 0.5e0) AS BIGINT)" for c, f in (("plate_x", "64e0"), ("plate_z", "64e0"), ("pfx_x", "12e0 * 64e0"), ("pfx_z", "12e0 * 64e0"), ("release_speed", "64e0")))}) AS place FROM ({_SAMPLED})) GROUP BY request_id) l ON q.success AND q.request_id = l.request_id""", "asked_rows")
def report_json(w: World) -> DataFrame:
    """The reports as JSON, read back and flattened."""
    return report.flattened(report.report(w["pitches"], w["matchup_requests"], w["players"], fixtures.AS_OF))


@query("location_sample_by_request", f"SELECT request_id, {KEYS}, pitch_type, plate_x, plate_z FROM ({_SAMPLED})", "asked_rows")
def location_sample_by_request(w: World) -> DataFrame:
    """The sample of every request's window, from dyadic blocks of days."""
    resolved = materialise(report.resolve(w["matchup_requests"], w["players"], fixtures.AS_OF), "resolved")
    windows = materialise(lookup.windows(resolved), "windows")
    found = cube.window_samples(cube.near_windows(clean_rows(w), windows), windows, (*KEY, "pitch_type", "plate_x", "plate_z"))
    return found.join(resolved.select("request_id", lookup.window_key().alias("window")), "window").select("request_id", *KEY, "pitch_type", "plate_x", "plate_z")


# Aggregations


@query("arsenal", "SELECT * FROM arsenal", "arsenal")
def arsenal_query(w: World) -> DataFrame:
    return arsenal.arsenal(clean_rows(w))


@query("run_value_totals", f"SELECT pitcher, pitch_type, count(*) AS count, CAST(sum(rv) AS BIGINT) AS rv_cents, {rounded('sum(rv) * 1e0 / count(*)', 2)} AS rv_per_100 FROM (SELECT *, {_RUN_VALUE} AS rv FROM pitches) GROUP BY pitcher, pitch_type", "pitches")
def run_value_totals(w: World) -> DataFrame:
    return arsenal.run_value_totals(w["pitches"])


def _rate_sql(name: str) -> str:
    part, whole = outcomes.RATES[name]
    return rounded(f"{part} * 100e0 / nullif({whole}, 0)", 1)


def _rate_query(name: str) -> None:
    part, whole = outcomes.RATES[name]

    @query(name, f"SELECT pitcher, pitch_type, stand, {part}, {whole}, {_rate_sql(name)} AS {name} FROM outcomes", "outcomes")
    def run(w: World) -> DataFrame:
        return outcomes.counters(w["pitches"]).select(*outcomes.KEYS, part, whole, outcomes.rate(name))


for _name in outcomes.RATES:
    _rate_query(_name)


@query("outcome_stats", f"SELECT pitcher, pitch_type, stand, sample_size, {rounded('speed', 1)} AS avg_speed, {', '.join(f'{_rate_sql(n)} AS {n}' for n in outcomes.RATES)} FROM outcomes", "outcomes")
def outcome_stats(w: World) -> DataFrame:
    return outcomes.outcome_stats(w["pitches"])


@query("outcome_flags", f"SELECT pitcher, pitch_type, stand, coalesce({_rate_sql('whiff_rate')} > 30, false) AS high_whiff, coalesce({_rate_sql('put_away_rate')} > 20, false) AS high_put_away FROM outcomes", "outcomes")
def outcome_flags(w: World) -> DataFrame:
    return outcomes.outcome_flags(outcomes.outcome_stats(w["pitches"]))


@query("heatmap", """SELECT *, xi * 0.25e0 + -1.75e0 + 0.125e0 AS x, zi * 0.25e0 + 1e0 + 0.125e0 AS z, -(xi * 0.25e0 + -1.75e0 + 0.125e0) AS drawn_x, 0.6e0 - intensity * 0.6e0 AS hue, intensity * 0.6e0 + 0.3e0 AS opacity
FROM (SELECT *, count * 1e0 / max(count) OVER (PARTITION BY pitcher) AS intensity FROM (
  SELECT pitcher, CAST(floor((plate_x - -1.75e0) / 0.25e0) AS BIGINT) AS xi, CAST(floor((plate_z - 1e0) / 0.25e0) AS BIGINT) AS zi, count(*) AS count FROM clean GROUP BY 1, 2, 3))""", "clean")
def heatmap(w: World) -> DataFrame:
    return charts.heatmap(clean_rows(w))


_BINS = "(SELECT pitcher, CAST(floor(release_speed + 0.5e0) AS BIGINT) AS speed, pitch_type, count(*) AS count FROM clean WHERE release_speed IS NOT NULL GROUP BY 1, 2, 3)"


@query("velocity_bins", f"SELECT * FROM {_BINS}", "clean")
def velocity_bins(w: World) -> DataFrame:
    return charts.velocity_bins(clean_rows(w))


_TYPE_SUMS = ", ".join(f"CAST(sum(count) FILTER (WHERE pitch_type = '{t}') AS BIGINT) AS {t}" for t in C.VALID_ARSENAL)


@query("velocity_histogram", f"SELECT pitcher, speed, CAST(sum(count) AS BIGINT) AS total, {_TYPE_SUMS} FROM {_BINS} GROUP BY pitcher, speed", "clean")
def velocity_histogram(w: World) -> DataFrame:
    return charts.velocity_histogram(clean_rows(w))


@query("pitch_types", "SELECT DISTINCT pitcher, pitch_type FROM clean", "clean")
def pitch_types(w: World) -> DataFrame:
    return charts.pitch_types(clean_rows(w))


_STAT_NAMES = [f"{c}_{s}" for c in C.FEATURES for s in ("mean", "std")]


def coded_rows(w: World) -> tuple[DataFrame, DataFrame]:
    rows = clean.training_rows(w["pitches"])
    codes = sequences.label_codes(rows)
    return sequences.encoded(rows, codes), codes


@query("scaler_stats", "SELECT " + ", ".join(f"{rounded(n, 6)} AS {n}" for n in _STAT_NAMES) + " FROM stats", "stats")
def scaler_stats(w: World) -> DataFrame:
    return sequences.scaler_stats(coded_rows(w)[0]).select(*[F.expr(rounded(n, 6)).alias(n) for n in _STAT_NAMES])


# Windows, sorts, top-k


@query("pitch_order", f"SELECT {KEYS}, row_number() OVER (ORDER BY {KEYS}) - 1 AS idx FROM pitches", "pitches")
def pitch_order(w: World) -> DataFrame:
    return sequences.pitch_order(w["pitches"]).select(*KEY, "idx")


_RAW = ("release_speed", "plate_x", "plate_z", "balls", "strikes", "stand")


def _windows_sql(columns: tuple[str, ...], label: str, limit: int | None, source: str, partition: str = "") -> str:
    lags = ", ".join(f"lag({c}, {k}) OVER w AS {c}_{C.SEQUENCE - k + 1}" for k in range(1, C.SEQUENCE + 1) for c in columns)
    inner = f"SELECT *, row_number() OVER (ORDER BY {KEYS}) - 1 AS idx FROM {source}"
    cut = f"WHERE idx < {limit}" if limit else ""
    return f"SELECT * EXCLUDE (place) FROM (SELECT idx, {label} AS label, row_number() OVER w AS place, {lags} FROM ({inner}) {cut} WINDOW w AS ({partition} ORDER BY idx)) WHERE place > {C.SEQUENCE}"


def _windows_query(name: str, limit: int | None, boundary: str, partition: str = "") -> None:
    @query(name, _windows_sql(_RAW, "pitch_type", limit, "training", partition), "training")
    def run(w: World) -> DataFrame:
        return sequences.windows(sequences.pitch_order(clean.training_rows(w["pitches"])), _RAW, "pitch_type", limit=limit, boundary=boundary)


_windows_query("pitch_sequences", None, "global")
_windows_query("pitch_sequences_by_game", None, "game", "PARTITION BY game_pk")
_windows_query("pitch_sequences_by_pitcher_game", None, "pitcher_game", "PARTITION BY game_pk, pitcher")
_windows_query("training_limit", C.TRAINING_LIMIT, "global")


@query("location_sample", f"SELECT {KEYS}, pitcher FROM (SELECT *, row_number() OVER (PARTITION BY pitcher ORDER BY {charts.SAMPLE_ORDER}, {KEYS}) AS r FROM clean) WHERE r <= {C.MAX_LOCATIONS}", "clean")
def location_sample(w: World) -> DataFrame:
    return charts.location_sample(clean_rows(w)).select(*KEY, "pitcher")


@query("top_predictions", "SELECT * FROM top_k", "top_k")
def top_predictions(w: World) -> DataFrame:
    return scoring.top_predictions(w["class_probabilities"])


@query("arsenal_ranked", f"""SELECT pitcher, CAST(row_number() OVER (PARTITION BY pitcher ORDER BY percentage DESC, pitch_type) AS INTEGER) AS rank, pitch_type, {E.PITCH_NAME} AS pitch_name, percentage,
  least(abs(run_value_per_100) / 5e0 * 100e0, 100e0) AS bar, least(abs(run_value_per_100) / 5e0 * 100e0, 100e0) / 2e0 AS drawn, CASE WHEN run_value_per_100 < 0 THEN 'good' ELSE 'bad' END AS sign FROM arsenal""", "arsenal")
def arsenal_ranked(w: World) -> DataFrame:
    return arsenal.ranked(arsenal.arsenal(clean_rows(w)))


# Kinematics


@query("flight_params", f"SELECT {KEYS}, flight, ax, az FROM ({_flight(_INCHES)})", "clean")
def flight_params(w: World) -> DataFrame:
    return kinematics.flight_params(in_inches(clean_rows(w))).select(*KEY, "flight", "ax", "az")


def _points_at(rows: DataFrame, *steps: int) -> DataFrame:
    """Some points of each flight side by side, and the extremes over all points."""
    extremes = [f(f"points.{c}").alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.array_min), ("max", F.array_max))]
    return rows.select(*KEY, F.size("points").cast("long").alias("n_points"), *[F.element_at("points", i + 1)[c].alias(f"{c}_{i}") for i in steps for c in "xyz"], *extremes)


def _extremes(shape: dict[str, str]) -> str:
    every = {k: f"[{v.format(**kinematics.NAMES, t=f'(i / {kinematics.STEPS}e0 * flight)')} for i in range(0, {kinematics.STEPS + 1})]" for k, v in shape.items()}
    return ", ".join(f"list_{n}({v}) AS {k}_{n}" for k, v in every.items() for n in ("min", "max"))


@query("trajectory", f"SELECT {KEYS}, {kinematics.STEPS + 1} AS n_points, {_at(E.FREE, '20', '_20')}, {_at(E.FREE, '40', '_40')}, {_extremes(E.FREE)} FROM ({_flight(_INCHES)})", "clean")
def trajectory(w: World) -> DataFrame:
    return _points_at(kinematics.trajectory(in_inches(clean_rows(w))), 20, 40)


@query("trajectory_to_plate", f"SELECT {KEYS}, {kinematics.STEPS + 1} AS n_points, {_at(E.TO_PLATE, '20', '_20')}, {_at(E.TO_PLATE, '40', '_40')}, {_extremes(E.TO_PLATE)} FROM ({_solved(_INCHES)})", "clean")
def trajectory_to_plate(w: World) -> DataFrame:
    return _points_at(kinematics.trajectory_to_plate(in_inches(clean_rows(w))), 20, 40)


@query("trajectory_inputs", f"SELECT {KEYS}, {', '.join(E.INPUT_DEFAULTS)} FROM ({_INPUTS} pitches)", "pitches")
def trajectory_inputs(w: World) -> DataFrame:
    return kinematics.trajectory_inputs(w["pitches"]).select(*KEY, *E.INPUT_DEFAULTS)


def arsenal_flights(w: World) -> DataFrame:
    rows = arsenal.arsenal(clean_rows(w)).withColumn("release_speed", F.col("avg_velocity"))
    return kinematics.trajectory_to_plate(kinematics.trajectory_inputs(rows))


@query("arsenal_trajectories", f"SELECT pitcher, pitch_type, CAST(i AS INTEGER) AS i, {_at(E.TO_PLATE, 'i')} FROM ({_solved(f'({_INPUTS} {_ARSENAL_INPUT})')}), {_STEPS}", "arsenal")
def arsenal_trajectories(w: World) -> DataFrame:
    return kinematics.exploded(arsenal_flights(w), "pitcher", "pitch_type")


_SIMULATED = f"(SELECT pitcher, pitch_type, batter_stand, {E.SIM_SPEED} AS release_speed, {E.SIM_BREAK} AS pfx_z, -2e0 AS release_pos_x, 6e0 AS release_pos_z, -5e0 AS pfx_x, 6e0 AS release_extension FROM {_SIMULATIONS})"


@query("simulate_trajectory", f"SELECT pitcher, pitch_type, batter_stand, CAST(i AS INTEGER) AS i, {_at(E.FREE, 'i')} FROM ({_flight(_SIMULATED)}), {_STEPS}", "contexts")
def simulate_trajectory(w: World) -> DataFrame:
    return kinematics.exploded(kinematics.simulate(simulation_requests(w)), "pitcher", "pitch_type", "batter_stand")


@query("plate_crossing", f"SELECT *, -x AS drawn_x FROM (SELECT pitcher, pitch_type, {_at(E.TO_PLATE, '40')} FROM ({_solved(f'({_INPUTS} {_ARSENAL_INPUT})')}))", "arsenal")
def plate_crossing(w: World) -> DataFrame:
    return kinematics.plate_crossing(arsenal_flights(w), "pitcher", "pitch_type")


# Models


@query("label_codes", "SELECT * FROM codes", "codes")
def label_codes(w: World) -> DataFrame:
    return coded_rows(w)[1]


_SCALED = ", ".join(f"({c} - {c}_mean) / {c}_std AS {c}" for c in C.FEATURES)
_SIX = [f"{c}_{k}" for k in range(1, C.SEQUENCE + 1) for c in C.FEATURES]


@query("scaled_features", f"SELECT {KEYS}, label, " + ", ".join(f"{rounded(f'({c} - {c}_mean) / {c}_std', 6)} AS {c}" for c in C.FEATURES) + " FROM coded, stats", "stats")
def scaled_features(w: World) -> DataFrame:
    rows, _ = coded_rows(w)
    return sequences.scaled(rows, sequences.scaler_stats(rows)).select(*KEY, "label", *[F.expr(rounded(c, 6)).alias(c) for c in C.FEATURES])


@query("sequence_dataset", "SELECT idx, label, " + ", ".join(f"{rounded(c, 6)} AS {c}" for c in _SIX) + f" FROM ({_windows_sql(C.FEATURES, 'label', C.TRAINING_LIMIT, f'(SELECT {KEYS}, label, {_SCALED} FROM coded, stats)')})", "stats")
def sequence_dataset(w: World) -> DataFrame:
    return sequences.sequence_dataset(clean.training_rows(w["pitches"])).select("idx", "label", *[F.expr(rounded(c, 6)).alias(c) for c in _SIX])


def fitted(w: World) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training rows, label codes and scaler statistics, each derived once and written."""
    rows = materialise(clean.training_rows(w["pitches"]), "training")
    codes = materialise(sequences.label_codes(rows), "codes")
    return rows, codes, materialise(sequences.scaler_stats(sequences.encoded(rows, codes)), "stats")


def training_windows(w: World) -> DataFrame:
    """The training data."""
    rows, codes, stats = fitted(w)
    return materialise(sequences.sequence_dataset(rows, codes=codes, stats=stats), "dataset")


@query("train_sequence_model")
def train_sequence_model(w: World) -> DataFrame:
    """The loss by iteration, and (iteration null) the held-out loss beside that of the labels' shares alone."""
    learned, judged = models.held_out(training_windows(w))
    model = models.train_sequence_model(learned)
    losses = models.log_losses(model, learned, judged)
    at = F.lit(None).cast("int").alias("iteration")
    history = models.loss_history(learned.sparkSession, model).select(F.lit("loss").alias("measure"), "iteration", F.col("loss").alias("value"))
    return history.unionByName(losses.select(F.lit("held_out_loss").alias("measure"), at, F.col("held_out_loss").alias("value"))).unionByName(losses.select(F.lit("prior_loss").alias("measure"), at, F.col("prior_loss").alias("value")))


@query("train_context_model")
def train_context_model(w: World) -> DataFrame:
    rows = materialise(models.cases(w["pitches"].where("pitch_type IS NOT NULL")), "cases")
    model = models.train_context_model(rows)
    contexts = models.context_rows(rows.select(*models.CONTEXT).distinct().withColumn("pitch_type", F.lit("FF")))
    return models.class_probabilities(model, contexts).select(*models.CONTEXT, "probabilities")


_OTHERS = "sum(n) OVER (PARTITION BY {keys}) - sum(n) OVER (PARTITION BY {keys}, fold)"
_NESTED = {"league": "1", "pitcher": "pitcher", "cell": "pitcher, stand, balls, strikes"}
_FOLDED = f"""SELECT pitcher, stand, balls, strikes, coalesce(game_pk % {backoff.FOLDS}, 0) AS fold, pitch_type, count(*) AS n FROM pitches
    WHERE pitch_type IS NOT NULL GROUP BY ALL"""
_SHARE = "1e0 / kinds"
for _level, _weight_of in zip(_NESTED, backoff.WEIGHTS):
    _SHARE = f"(({_level}_type + {_weight_of}e0 * {_SHARE}) / ({_level}_all + {_weight_of}e0))"


@query("context_backoff", f"""SELECT pitcher, stand, balls, strikes, CAST(fold AS INTEGER) AS fold, pitch_type, n, {rounded(_SHARE, 6)} AS probability FROM (
  SELECT *, (SELECT count(DISTINCT pitch_type) FROM pitches) AS kinds,
    {", ".join(f"{_OTHERS.format(keys=k + ', pitch_type')} AS {a}_type, {_OTHERS.format(keys=k)} AS {a}_all" for a, k in _NESTED.items())}
  FROM ({_FOLDED}))""", "pitches")
def context_backoff(w: World) -> DataFrame:
    """What each fold of games holds by context, with the probability that the other folds give it."""
    rows = w["pitches"]
    classes = backoff.pitch_classes(rows)
    shares = backoff.out_of_fold(materialise(backoff.class_counts(rows, classes), "class-counts"), classes)
    return backoff.observed(shares, classes).withColumn("probability", F.expr(rounded("probability", 6)))


@query("train_backoff_model")
def train_backoff_model(w: World) -> DataFrame:
    """Mean negative log-likelihood of held-out games' pitch types, for the 63 pitchers that a forest over pitchers tells
    apart and for all others: by that forest, by a forest over shares, and by the shares alone."""
    held = F.coalesce(F.pmod(F.xxhash64("game_pk"), F.lit(10)) == 0, F.lit(False))
    pitches = w["pitches"].where("pitch_type IS NOT NULL").withColumns({"held": held, "fold": backoff.fold()})
    rows = materialise(models.cases(pitches, "held", "fold"), "cases").withColumnRenamed("fold", "game_pk")  # a game for each fold
    held = F.col("held")
    learned, classes = rows.where(~held).drop("held"), backoff.pitch_classes(rows.where(~held))
    if not classes:
        return rows.sparkSession.createDataFrame([], "pitchers string, n long, class_loss double, forest_loss double, share_loss double")
    counts = materialise(backoff.class_counts(learned, classes), "class-counts")
    weights = backoff.fit_weights(counts, classes)
    forest = backoff.train_forest(materialise(backoff.with_out_of_fold(learned, counts, classes, weights), "shares"), classes)
    by_class = models.train_context_model(learned)
    judged = backoff.with_shares(rows.where(held & F.col("pitch_type").isin(classes)), counts, classes, weights)
    judged = models.class_probabilities(by_class, backoff.forest_probabilities(forest, judged).withColumnRenamed("probabilities", "by_forest"))
    group = F.when(F.col("pitcher_class") == models.OTHER, "rare").otherwise("frequent").alias("pitchers")
    losses = {"class_loss": "probabilities", "forest_loss": "by_forest", "share_loss": "shares"}
    return judged.groupBy(group).agg(F.sum("n").alias("n"), *[(F.sum(F.col("n") * backoff.log_loss(classes, c)) / F.sum("n")).alias(k) for k, c in losses.items()])


@query("save_model")
def save_model(w: World) -> DataFrame:
    """Predictions of a model that was trained, published with its encoders and loaded again."""
    rows, codes, stats = fitted(w)
    dataset, root = materialise(sequences.sequence_dataset(rows, codes=codes, stats=stats), "dataset"), shared_folder(rows.sparkSession, "bundle")
    encoders = bundles.Encoders.of(codes, stats)
    bundles.publish(rows.sparkSession, root, bundles.Bundle("perceptron", encoders, models.train_sequence_model(dataset, classes=encoders.num_classes)))
    bundle = bundles.load(rows.sparkSession, root, encoders.classes)
    types = bundle.encoders.codes(rows.sparkSession).where("kind = 'pitch_type'").select(F.col("code").alias("predicted"), F.col("value").alias("pitch_type"))
    return models.predictions(bundle.model, dataset).join(F.broadcast(types), "predicted", "left")  # a row per class


FIT_WINDOWS = 50_000  # rows, from the first on, whose windows the recurrent network is trained on


def next_pitch(w: World) -> str:
    """Where the recurrent network for these pitches is published: a place of their own below the shared folder."""
    files = "|".join(sorted(w["pitches"].inputFiles()))
    return f"{shared_base(w['pitches'].sparkSession)}/next-pitch-{hashlib.sha256(files.encode()).hexdigest()[:16]}"


def train_network(w: World) -> tuple[list[float], DataFrame, DataFrame, bundles.Bundle]:
    """Train the recurrent network on the first windows but one in ten, publish it; the losses, windows learned from and held
    out, and the bundle."""
    rows, codes, stats = fitted(w)
    dataset = materialise(sequences.sequence_dataset(rows, limit=FIT_WINDOWS, codes=codes, stats=stats), "dataset")
    learned, judged = models.held_out(dataset)
    encoders = bundles.Encoders.of(codes, stats)
    weights, losses = recurrent.train(learned, encoders.num_classes)
    bundle = bundles.Bundle("recurrent", encoders, weights)
    bundles.publish(rows.sparkSession, next_pitch(w), bundle)
    return losses, learned, judged, bundle


def network(w: World) -> bundles.Bundle:
    """The published recurrent network; it is trained only if none has been."""
    spark, root = w["pitches"].sparkSession, next_pitch(w)
    if bundles.current(spark, root) is None:
        train_network(w)
    return bundles.load(spark, root)


@query("train_recurrent_model")
def train_recurrent_model(w: World) -> DataFrame:
    """The recurrent network's mean training loss by epoch, and (iteration null) its held-out loss beside that of the labels'
    shares alone; the network is published for the scoring queries."""
    losses, learned, judged, bundle = train_network(w)
    spark = learned.sparkSession
    found = recurrent.held_out_loss(judged, bundle.model).first()[0]
    prior = models.prior_loss(learned, judged.na.drop(subset=scoring.INPUTS)).first()[0]
    rows = [("loss", k, float(x)) for k, x in enumerate(losses)] + [("held_out_loss", None, found), ("prior_loss", None, prior)]
    return spark.createDataFrame(rows, "measure string, iteration int, value double")


@query("lstm_score")
def lstm_score(w: World) -> DataFrame:
    """Every window of the training rows scored by the published network, with the network's own encoders."""
    bundle, spark = network(w), w["pitches"].sparkSession
    rows = clean.training_rows(w["pitches"])
    windows = sequences.sequence_dataset(rows, limit=None, codes=bundle.encoders.codes(spark), stats=bundle.encoders.stats(spark))  # the cap is the training set's
    return scoring.lstm_score(windows, bundle.model, "idx", "label")


@query("predict_context")
def predict_context(w: World) -> DataFrame:
    """The published network's predictions for every context; nothing is trained where one is published."""
    bundle, spark = network(w), w["pitches"].sparkSession
    types = arsenal.arsenal(clean_rows(w)).select("pitcher", "pitch_type")
    return scoring.predict_contexts(w["contexts"], bundle.model, bundle.encoders.codes(spark), bundle.encoders.stats(spark), types)


# Stored states


def landed(w: World, *kinds: str) -> str:
    """The pitches landed a year at a time, with states of these kinds that were brought up to date after each."""
    spark = w["pitches"].sparkSession
    table = f"{shared_folder(spark, 'states')}/table"
    for year in _YEARS:
        landing.land(fixtures.of_year(w, year).withColumn("game_year", F.year("game_date")), table, f"year-{year}")
        states.refresh(spark, table, kinds)
    return table


@query("scaler_stats_from_states")
def scaler_stats_from_states(w: World) -> DataFrame:
    spark, table = w["pitches"].sparkSession, landed(w, "moments", "classes")
    found = states.scaler_stats(states.read(spark, table, "moments"), states.read(spark, table, "classes"))
    return found.select(*[F.expr(rounded(n, 6)).alias(n) for n in _STAT_NAMES])


@query("label_codes_from_states")
def label_codes_from_states(w: World) -> DataFrame:
    return states.label_codes(states.read(w["pitches"].sparkSession, landed(w, "classes"), "classes"))


@query("run_value_totals_from_states")
def run_value_totals_from_states(w: World) -> DataFrame:
    return states.run_value_totals(states.read(w["pitches"].sparkSession, landed(w, "run_values"), "run_values"))


@query("table_stats_from_states")
def table_stats_from_states(w: World) -> DataFrame:
    return states.table_stats(w["pitches"].sparkSession, landed(w, "bitmaps")).withColumn("game_year", F.col("game_year").cast("long"))


@query("sequence_dataset_from_states")
def sequence_dataset_from_states(w: World) -> DataFrame:
    """The windows of years that landed and were windowed one by one, with encoders from the stored states."""
    spark = w["pitches"].sparkSession
    table = f"{shared_folder(spark, 'increments')}/table"
    for year in _YEARS:
        landing.land(fixtures.of_year(w, year).withColumn("game_year", F.year("game_date")), table, f"year-{year}")
        increments.refresh(spark, table)
    states.refresh(spark, table, ("moments", "classes"))
    classes = states.read(spark, table, "classes")
    found = increments.dataset(increments.windows(spark, table), states.label_codes(classes), states.scaler_stats(states.read(spark, table, "moments"), classes))
    return found.select("idx", "label", *[F.expr(rounded(c, 6)).alias(c) for c in _SIX])


for _name in ("scaler_stats", "label_codes", "run_value_totals", "table_stats", "sequence_dataset"):
    ORACLES[f"{_name}_from_states"] = ORACLES[_name]  # the same rows, from what is stored


@query("rule_based_predictions", "SELECT pitcher, batter_stand, balls, strikes, r.* FROM contexts, (VALUES (1, 'FF', 50e0), (2, 'SL', 30e0)) AS r(rank, pitch_type, percent)", "contexts")
def rule_based_predictions(w: World) -> DataFrame:
    return scoring.rule_based(w["contexts"])
