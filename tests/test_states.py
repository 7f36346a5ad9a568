"""States that are stored by landing and folded agree with one look at all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from moundworks.operators import arsenal, clean, sequences, states
from moundworks.sources import ingest, landing

COLUMNS = "game_pk long, game_date string, pitcher long, stand string, pitch_type string, release_speed double, plate_x double, plate_z double, balls int, strikes int, events string, description string"


def rows_of(year, n, offset, seed):
    r = random.Random(seed)
    some = lambda x: None if r.random() < 0.1 else x
    return [(some(r.randrange(10**6)), f"{year}-05-{r.randrange(1, 29):02d}", some(r.randrange(-50, 50)), r.choice(["L", "R", None]), some(r.choice(["FF", "SL", "CU"])), offset + r.random(), some(-offset + r.gauss(0, 1)), some(r.random()),
             r.randrange(4), r.randrange(3), some("single"), "ball") for _ in range(n)]


def frame(spark, rows):
    return ingest.typed(spark.createDataFrame(rows, COLUMNS)).withColumn("game_year", F.year("game_date"))


def land(spark, table, parts):
    for name, rows in parts.items():
        landing.land(frame(spark, rows), table, name)
        states.refresh(spark, table)


def test_folded_states_equal_one_scan(spark, tmp_path):
    offset, table = 1e6, f"file://{tmp_path}/t"
    parts = {"a": rows_of(2021, 50, offset, 1), "b": rows_of(2022, 300, offset, 2), "c": rows_of(2023, 200, offset + 40, 3) + rows_of(2022, 77, offset - 3, 4)}
    land(spark, table, parts)
    whole = [r for rows in parts.values() for r in rows]
    df = frame(spark, whole)
    used = [r for r in whole if r[1] >= "2022" and r[4] is not None and r[6] is not None]
    found = states.scaler_stats(states.read(spark, table, "moments"), states.read(spark, table, "classes")).first()
    for name, at in (("release_speed", 5), ("plate_x", 6), ("plate_z", 7), ("balls", 8), ("strikes", 9)):
        values = [float(r[at]) for r in used if r[at] is not None]
        mean = math.fsum(values) / len(values)
        deviation = math.sqrt(math.fsum((x - mean) ** 2 for x in values) / len(values))
        assert found[f"{name}_mean"] == pytest.approx(mean, rel=1e-12, abs=1e-12) and found[f"{name}_std"] == pytest.approx(deviation, rel=1e-9 if at in (5, 6) else 1e-12)
    training = clean.training_rows(df)
    codes = sequences.label_codes(training)
    scan = sequences.scaler_stats(sequences.encoded(training, codes)).first()
    for name in ("stand_code_mean", "stand_code_std"):
        assert found[name] == pytest.approx(scan[name], rel=1e-12)
    assert sorted(map(str, states.label_codes(states.read(spark, table, "classes")).collect())) == sorted(map(str, codes.collect()))
    assert sorted(map(str, states.run_value_totals(states.read(spark, table, "run_values")).collect())) == sorted(map(str, arsenal.run_value_totals(df).collect()))
    assert sorted(map(str, states.table_stats(spark, table).collect())) == sorted(map(str, ingest.table_stats(df).collect()))
    total = states.distinct_counts(states.read(spark, table, "bitmaps")).first()
    assert (total["games"], total["pitchers"]) == (len({r[0] for r in whole} - {None}), len({r[2] for r in whole} - {None}))
    by_year = {r["game_year"]: r["n"] for r in states.merged_moments(states.read(spark, table, "moments"), "game_year").where("feature = 'plate_z'").collect()}
    assert by_year == {y: sum(r[1][:4] == str(y) and r[7] is not None for r in used) for y in (2022, 2023)}
    assert states.read(spark, table, "moments", (2023,)).select("game_year").distinct().count() == 1


def test_only_what_is_new_is_read(spark, tmp_path, monkeypatch):
    """A year without training rows is not looked at twice; a new landing is read alone."""
    table, asked, read = f"file://{tmp_path}/t", [], landing.read_table
    monkeypatch.setattr(landing, "read_table", lambda spark, path, years=None, landings=None: asked.append(landings) or read(spark, path, years, landings))
    land(spark, table, {"a": rows_of(2021, 9, 0.0, 1), "b": rows_of(2022, 20, 0.0, 2)})
    assert {len(x) for x in asked} == {1} and len(set(asked)) == 2 and len(asked) == 2 * len(states.KINDS)
    assert set(states.refresh(spark, table).values()) == {0} and len(asked) == 2 * len(states.KINDS)


def test_states_that_were_appended_twice_count_once(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    land(spark, table, {"a": rows_of(2022, 40, 0.0, 5)})
    want = sorted(map(str, states.run_value_totals(states.read(spark, table, "run_values")).collect()))
    again = spark.read.parquet(f"{table}/_states/run_values").collect()
    spark.createDataFrame(again, spark.read.parquet(f"{table}/_states/run_values").schema).withColumn("job", F.lit("0 other")).write.mode("append").parquet(f"{table}/_states/run_values")
    unpublished = spark.read.parquet(f"{table}/_states/run_values").where("job = '0 other'").withColumn("landing", F.lit("nobody's")).collect()
    spark.createDataFrame(unpublished, spark.read.parquet(f"{table}/_states/run_values").schema).write.mode("append").parquet(f"{table}/_states/run_values")
    assert sorted(map(str, states.run_value_totals(states.read(spark, table, "run_values")).collect())) == want


def test_no_rows(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    assert states.refresh(spark, table) == dict.fromkeys(states.KINDS, 0)
    assert states.table_stats(spark, table).count() == 0 and states.label_codes(states.read(spark, table, "classes")).count() == 0
    empty = states.scaler_stats(states.read(spark, table, "moments"), states.read(spark, table, "classes")).first()
    assert set(empty.asDict().values()) == {None}
    land(spark, table, {"none": []})
    assert states.table_stats(spark, table).count() == 0
