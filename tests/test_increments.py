"""Windows that are kept by landing agree with windows over all rows at once."""

import random

import pytest
from pyspark.sql import functions as F

from moundworks.operators import clean, increments, sequences
from moundworks.plans import queries
from moundworks.sources import fixtures, ingest, landing, shared

COLUMNS = "game_pk long, at_bat_number long, pitch_number long, game_date string, pitcher long, stand string, pitch_type string, release_speed double, plate_x double, plate_z double, balls int, strikes int"


def games_of(year, games, seed):
    """Rows of games of 1 to 24 pitches, some without values or outside the training rows."""
    r = random.Random(seed)
    out = []
    for g in games:
        for k in range(r.choice([1, 2, 3, 4, 5, 6, 9, 10, 11, 24])):
            out.append((g, k // 4, k % 4, f"{year}-06-01", r.randrange(3), r.choice(["L", "R", None]), r.choice(["FF", "SL", "CU", "CH", None]), 80 + r.random(), r.random(), r.choice([None, r.random()]), r.randrange(4), r.randrange(3)))
    r.shuffle(out)
    return out


def frame(spark, rows):
    return ingest.typed(spark.createDataFrame(rows, COLUMNS)).withColumn("game_year", F.year("game_date"))


def same(spark, table, rows, limit=None, boundary="global"):
    training = clean.training_rows(frame(spark, rows)).where("game_pk IS NOT NULL")
    codes = sequences.label_codes(training)
    stats = sequences.scaler_stats(sequences.encoded(training, codes))
    stats = spark.createDataFrame(stats.collect(), stats.schema)  # summed once, so that both use the same
    want = sequences.sequence_dataset(training, limit=limit, boundary=boundary, codes=codes, stats=stats)
    got = increments.dataset(increments.windows(spark, table, limit, boundary), codes, stats)
    assert set(got.columns) == set(want.columns)
    wanted, found = sorted(map(str, want.select(*got.columns).collect())), sorted(map(str, got.collect()))
    assert found and not [(a, b) for a, b in zip(found, wanted) if a != b][:1] and len(found) == len(wanted)


def test_landings_before_between_and_after(spark, tmp_path, monkeypatch):
    table, seen, read = f"file://{tmp_path}/t", [], landing.read_table
    monkeypatch.setattr(landing, "read_table", lambda s, t, years=None, landings=None: seen.append(len(landings)) or read(s, t, years, landings))
    parts = [games_of(2022, range(100, 300, 4), 1), games_of(2023, range(0, 400, 5), 2), games_of(2024, [*range(401, 420), 3, 151, 153, 157], 3)]
    parts[1] = [x for x in parts[1] if x[0] % 4]  # another year's games in between, none of them shared
    whole = [(None, 1, 1, "2022-06-01", 1, "L", "FF", 90.0, 0.1, 0.1, 0, 0)]
    for k, part in enumerate(parts):
        whole += part
        landing.land(frame(spark, part if k else whole), table, f"unit-{k}")
        assert increments.refresh(spark, table) == 1 and increments.refresh(spark, table) == 0
        assert seen == [1] * (k + 1)  # one landing read by each refresh, the new one
        same(spark, table, whole)
    same(spark, table, whole, limit=77)
    same(spark, table, whole, boundary="game")
    with pytest.raises(ValueError):
        increments.windows(spark, table, boundary="pitcher_game")


def test_a_game_in_several_landings_and_a_job_that_fails(spark, tmp_path, monkeypatch):
    table = f"file://{tmp_path}/t"
    rows = games_of(2022, range(40), 5)
    cut = [[x for x in rows if x[0] % 3 or x[1] == 0], [x for x in rows if x[0] % 3 == 0 and x[1] in (1, 2)], [x for x in rows if x[0] % 3 == 0 and x[1] > 2]]
    for k, part in enumerate(cut):
        landing.land(frame(spark, part), table, f"unit-{k}")
        if k == 1:
            with monkeypatch.context() as m:
                m.setattr(increments, "JOBS", "no schema")  # fails when it publishes, with its rows written
                with pytest.raises(Exception):
                    increments.refresh(spark, table)
        assert increments.refresh(spark, table) == 1
        same(spark, table, [x for p in cut[: k + 1] for x in p])


def test_no_rows(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    assert increments.refresh(spark, table) == 0 and increments.windows(spark, table).count() == 0
    landing.land(frame(spark, games_of(2021, range(5), 1)), table, "before the floor")
    assert increments.refresh(spark, table) == 1 and increments.windows(spark, table).count() == 0


def test_growth(spark, tmp_path, monkeypatch):
    """A task holds some rows of a refresh, values are written once, and the first windows are read from the first games alone."""
    table = f"file://{tmp_path}/t"
    landing.land(frame(spark, games_of(2022, range(400), 8)), table, "unit")
    monkeypatch.setattr(shared, "ROWS", 100)
    increments.refresh(spark, table)
    stored = spark.read.parquet(f"{table}/_windows/rows")
    files = stored.groupBy(F.input_file_name(), "edge").count()
    assert files.agg(F.max("count")).first()[0] < 400 < stored.count() and not set(stored.columns) & set(increments.BEFORE)
    made = increments.windows(spark, table, limit=77)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert made.agg(F.max("idx")).first()[0] == 76 and "game_pk" in plan and "strategy=broadcast" in plan


def test_years_land_from_their_own_orders(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(landing, "land", lambda new, table, unit: plans.append(new._jdf.queryExecution().optimizedPlan().toString()))
    queries.landed(fixtures.world(spark, "/root/testdata/sf0.001"))
    assert len(plans) == 4 and all(p.index("Window") < p.index("Join") < p.rindex("year(") for p in plans)
    w = fixtures.world(spark, "/root/testdata/sf0.001")
    years = [fixtures.of_year(w, y) for y in fixtures.YEARS]
    assert sum(y.count() for y in years) == w["pitches"].count() and not w["pitches"].exceptAll(years[0].unionAll(years[1]).unionAll(years[2]).unionAll(years[3])).count()
