"""Windows answered from running totals and dyadic samples against windows joined with their pitches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from moundworks.operators import arsenal, charts, clean, cube, lookup
from moundworks.plans import report

DAY = datetime.date
COLUMNS = ("game_pk", "at_bat_number", "pitch_number", "pitcher", "game_date", "pitch_type", "release_speed", "pfx_x", "pfx_z", "plate_x", "plate_z", "release_pos_x", "release_pos_z", "release_extension", "events", "description")


@pytest.fixture(scope="module")
def pitches(spark):
    rng = random.Random(8)
    rows = []
    for k in range(6000):
        day = DAY(2022, 11, 20) + datetime.timedelta(days=rng.randrange(120) if k % 5 else 7)
        value = lambda: rng.choice([None, float("nan"), 1.0, 2.25, -0.5]) if rng.random() < 0.1 else rng.randrange(64) / 64  # noqa: E731, B023
        rows.append((k // 100, k // 10 % 10, k, rng.choice([1, 1, 1, 2, None]), day, rng.choice(["FF", "FF", "SL", "PO", None]), *(value() for _ in range(8)), rng.choice([None, "single"]), rng.choice(["ball", "foul", None])))
    return spark.createDataFrame(rows, "game_pk long, at_bat_number long, pitch_number long, pitcher long, game_date date, pitch_type string, release_speed double, pfx_x double, pfx_z double, plate_x double, plate_z double, release_pos_x double, release_pos_z double, release_extension double, events string, description string").cache()


def windows_of(spark, n, seed):
    rng, rows = random.Random(seed), set()
    while len(rows) < n:
        start = DAY(2022, 10, 1) + datetime.timedelta(days=rng.randrange(250))
        rows.add((rng.choice([1, 1, 2, 3]), start, start + datetime.timedelta(days=rng.choice([-5, 0, 1, rng.randrange(300)]))))
    return spark.createDataFrame([(f"w{k}", *r) for k, r in enumerate(sorted(rows))], "window string, pitcher long, start_date date, end_date date")


def rounded(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


def test_sums_equal_those_of_joined_rows(spark, pitches):
    windows = windows_of(spark, 150, 1)
    joined = lookup.pitches_in_windows(pitches, windows).withColumn("clean", clean.is_valid()).cache()
    sums = cube.window_sums(cube.daily(pitches), windows).cache()
    assert rounded(cube.window_counts(sums).collect()) == rounded(lookup.window_counts(joined).collect())
    counts = cube.window_sums(cube.daily_counts(cube.near_windows(pitches, windows)), windows, (cube.REST,)).drop("pitch_type")
    assert rounded(counts.collect()) == rounded(lookup.window_counts(joined).collect())
    measured = joined.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("release_pos_x", "release_pos_z", "release_extension")})
    got, want = cube.window_arsenal(sums), arsenal.arsenal(measured.where("clean"), "window")
    assert got.columns == want.columns and want.count() > 50
    assert [tuple(map(str, r)) for r in rounded(got.collect())] == [tuple(map(str, r)) for r in rounded(want.collect())]


def test_days_landed_in_parts_add_up(spark, pitches):
    windows = windows_of(spark, 40, 2)
    parts = [cube.daily(pitches.where(f"pmod(pitch_number, 3) = {k}")) for k in range(3)]
    whole = cube.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    found = [rounded(tuple(map(str, r)) for r in cube.window_arsenal(cube.window_sums(d, windows)).collect()) for d in (whole, cube.daily(pitches))]
    assert found[0] == found[1] != []


@pytest.mark.parametrize("most", [5, 1000])
def test_samples_equal_those_of_joined_rows(spark, pitches, most):
    windows, good = windows_of(spark, 60, 3), pitches.where(clean.is_valid())
    got = cube.window_samples(good, windows, ("game_pk", "at_bat_number", "pitch_number", "plate_x"), most)
    want = charts.location_sample(lookup.pitches_in_windows(good, windows), "window", most).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 60


def test_blocks_make_up_their_days(spark):
    rng, rows = random.Random(5), []
    for k in range(300):
        start = DAY(1990, 1, 1) + datetime.timedelta(days=rng.randrange(20000))
        rows.append((k, start, start + datetime.timedelta(days=rng.choice([-1, 0, 1, 6, rng.randrange(4000)]))))
    frame = spark.createDataFrame(rows, "k int, s date, e date")
    found = {}
    for k, day in frame.select("k", F.explode(cube.blocks("s", "e")).alias("b")).select("k", F.explode(cube.days_of("b"))).collect():
        found.setdefault(k, []).append(day.toordinal() - 1)
    for r in frame.select("k", "s", "e", F.expr(cube.day_number("s")).alias("a"), F.expr(cube.day_number("e")).alias("b"), cube.blocks("s", "e").alias("blocks")).collect():
        days = [d for x in r["blocks"] or [] for d in range(x["block"] << x["level"], (x["block"] + 1) << x["level"])]
        assert sorted(days) == list(range(r["a"], r["b"] + 1)) == sorted(found.get(r["k"], []))
        assert len(r["blocks"] or []) <= 2 * max(1, (r["b"] - r["a"] + 1).bit_length())


def test_work_does_not_grow_with_windows(spark, pitches):
    """10,000 windows on one pitcher: as many states as there are days, and every pitch once per block size at most."""
    one = pitches.where("pitcher = 1").cache()
    rng = random.Random(9)
    starts = [DAY(2022, 11, 1) + datetime.timedelta(days=rng.randrange(150)) for _ in range(10_000)]
    windows = spark.createDataFrame([(f"w{k}", 1, s, s + datetime.timedelta(days=rng.randrange(150))) for k, s in enumerate(starts)], "window string, pitcher long, start_date date, end_date date").cache()
    whole = cube.daily(one).cache()
    days, types = 301, len(cube.TYPES)
    asked = windows.select("pitcher", F.col("end_date").alias("day")).unionByName(windows.select("pitcher", F.date_sub("start_date", 1).alias("day")))
    assert cube.as_of(whole, asked).count() <= days * types
    used = cube.cut_windows(one, windows).select("pitcher", "b").distinct()
    assert cube.placed(one, used, charts.KEY).count() <= 8 * one.count()  # blocks of 1 to 128 days, however many windows
    assert used.select(F.explode(cube.days_of("b"))).count() <= 8 * 130
    assert cube.window_counts(cube.window_sums(whole, windows)).count() > 5000
    joined = lookup.pitches_in_windows(one, windows).groupBy("window").count()
    got = {r["window"]: r["n_rows"] for r in cube.window_counts(cube.window_sums(whole, windows)).collect()}
    assert got == {r["window"]: r["count"] for r in joined.collect()}


def test_a_report_from_stored_days(spark, pitches):
    requests = spark.createDataFrame([(1, "Ann Lee", DAY(2022, 12, 1), DAY(2023, 1, 31)), (2, "Ann Lee", None, None), (3, "Bo Ray", DAY(2023, 1, 1), None), (4, "No One", None, None)], "request_id int, pitcher_name string, start_date date, end_date date")
    players = spark.createDataFrame([(1, "Ann", "Lee", 2023), (2, "Bo", "Ray", 2023)], "key_mlbam long, name_first string, name_last string, mlb_played_last int")
    found = [sorted(map(str, report.report(pitches, requests, players, "2023-03-01", days).collect())) for days in (None, cube.daily(pitches))]
    assert found[0] == found[1] and sum("success" in r for r in found[0]) == 3
