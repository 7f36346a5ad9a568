"""Hand-worked cases and invariants."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from moundworks.functions import constants as C
from moundworks.operators import arsenal, bundles, charts, clean, kinematics, lookup, models, outcomes, scoring, sequences
from moundworks.plans import report
from moundworks.sources import fixtures, ingest, landing
from moundworks.streaming.landing import land_stream

DATA = "/root/testdata/sf0.001"


def pitches(spark, rows):
    """Pitches of (pitcher, pitch_type) with some valid numbers."""
    data = [(1, 1, k + 1, p, t, 90.0, 0.5, 1.0, 0.25, 2.5, -2.0, 6.0, 6.0, None, "ball") for k, (p, t) in enumerate(rows)]
    return spark.createDataFrame(data, "game_pk long, at_bat_number long, pitch_number long, pitcher long, pitch_type string, release_speed double, pfx_x double, pfx_z double, plate_x double, plate_z double, release_pos_x double, release_pos_z double, release_extension double, events string, description string")


@pytest.mark.parametrize(("events", "description", "cents"), [(None, "ball", 6), ("home_run", "hit_into_play", 140), ("field_error", "hit_into_play", 0), ("strikeout_double_play", "swinging_strike", -12), ("strikeout", "swinging_strike", -27), (None, "foul_tip", 0), (None, None, 0)])
def test_run_value(spark, events, description, cents):
    row = spark.createDataFrame([(events, description)], "events string, description string")
    assert arsenal.with_run_value(row).first()["rv"] == cents


def test_guards(spark):
    assert arsenal.arsenal(pitches(spark, [(1, "FF")] * 9)).count() == 0
    rows = arsenal.arsenal(pitches(spark, [(1, "FF")] * 6 + [(1, "SL")] * 4)).collect()
    assert [(r["pitch_type"], r["count"], r["percentage"]) for r in rows] == [("FF", 6, 60.0)]


def test_nan_is_missing(spark):
    rows = pitches(spark, [(1, "FF"), (1, None)]).withColumn("release_speed", F.lit(float("nan")))
    assert clean.valid_pitches(rows).count() == 0


def test_names(spark):
    players = spark.createDataFrame([(1, "Ann", "Lee", 2020), (2, "Ann", "Lee", None), (3, "Bob", "Lee", 2023), (4, "Ann", "Lee", 2020)], "key_mlbam long, name_first string, name_last string, mlb_played_last int")
    asked = spark.createDataFrame([(1, " ann  LEE "), (2, "lee"), (3, "ann q lee"), (4, "zed lee"), (5, "nobody"), (6, ""), (7, None)], "request_id long, pitcher_name string")
    found = {r["request_id"]: r["key_mlbam"] for r in lookup.latest_namesake(lookup.player_candidates(asked, players)).collect()}
    assert found == {1: 1, 2: 3, 3: 1, 4: 3}


def flight(spark, **values):
    base = {"release_speed": 90.0, "pfx_x": 0.0, "pfx_z": 0.0, "plate_x": 0.0, "plate_z": 2.5, "release_pos_x": -1.5, "release_pos_z": 6.0, "release_extension": 6.0}
    return spark.createDataFrame([tuple((base | values).values())], ", ".join(f"{c} double" for c in base))


def test_simulated_flights(spark):
    rows = spark.createDataFrame([("FF",), ("SL",), ("XX",)], "pitch_type string")
    got = {r["pitch_type"]: r for r in kinematics.simulate(rows).collect()}
    want = {
        "FF": (0.4116871407368731, 4.916818198559718, -22.340363602880565, (2.1041666666666665, 26.00865439467827, 3.776701798875729), (2.416666666666667, -2.6945490879535834, 0.6068071955029166)),
        "SL": (0.45527754387371855, 4.02037250844205, -36.19437250844205, (2.1041666666666665, 25.985034807111028, 3.3122144767980544), (2.4166666666666665, -2.78902743822255, 0.05)),
        "XX": (0.4299843469918453, 4.507268832993856, -27.666731167006144, (2.1041666666666665, 25.99902924667208, 3.6105992298188405), (2.4166666666666665, -2.7330496799783446, 0.05)),
    }
    for kind, (time, ax, az, middle, last) in want.items():
        r = got[kind]
        assert len(r["points"]) == 41
        assert np.allclose([r["flight"], r["ax"], r["az"]], [time, ax, az], atol=1e-9)
        assert np.allclose([r["points"][20][c] for c in "xyz"], middle, atol=1e-9)
        assert np.allclose([r["points"][40][c] for c in "xyz"], last, atol=1e-9)


def test_flight_to_plate(spark):
    r = kinematics.trajectory_to_plate(flight(spark)).first()
    assert np.allclose([r["flight"], r["vx0"], r["vz0"]], [0.4299843469918453, -3.4884990825688074, -1.2226730026027355], atol=1e-9)
    r = kinematics.trajectory_to_plate(flight(spark, release_speed=95.0, release_pos_x=-2.0, pfx_x=-6.0, pfx_z=15.0, plate_x=0.5, plate_z=3.0, release_extension=6.5)).first()
    assert np.allclose([r["points"][20][c] for c in "xyz"], [0.625, 25.875, 4.842668012854003], atol=1e-9)
    assert np.allclose([r["points"][40][c] for c in "xyz"], [-0.5, -2.25, 3.0], atol=1e-9)


def test_flight_inputs(spark):
    bad = flight(spark, release_speed=float("nan"), plate_x=float("inf"), pfx_z=None)
    r = kinematics.trajectory_inputs(bad).first()
    assert (r["release_speed"], r["plate_x"], r["pfx_z"]) == (90.0, 0.0, 0.0)


def test_heatmap_cells(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.5), (1, -1.75, 1.0), (1, -2.0, 0.9), (1, 0.0, 2.5), (1, None, 1.0)], "pitcher long, plate_x double, plate_z double")
    got = {(r["xi"], r["zi"]): (r["x"], r["z"], r["intensity"]) for r in charts.heatmap(rows).collect()}
    assert got == {(7, 6): (0.125, 2.625, 1.0), (0, 0): (-1.625, 1.125, 0.5), (-1, -1): (-1.875, 0.875, 0.5)}


def test_velocity_rounds_half_up(spark):
    rows = spark.createDataFrame([(1, "FF", 94.5), (1, "FF", 94.49)], "pitcher long, pitch_type string, release_speed double")
    assert sorted(r["speed"] for r in charts.velocity_bins(rows).collect()) == [94, 95]


def ordered(spark, n, games=1):
    return spark.createDataFrame([(k // max(1, n // games), 1, k, k % 3, float(k)) for k in range(n)], "game_pk long, at_bat_number long, pitch_number long, pitcher long, v double")


@pytest.mark.parametrize(("n", "limit", "made"), [(7, None, 2), (5, None, 0), (7, 6, 1), (0, None, 0)])
def test_window_counts(spark, n, limit, made):
    assert sequences.windows(sequences.pitch_order(ordered(spark, n)), ("v",), "v", limit=limit).count() == made


@pytest.mark.parametrize("block", [5, 7, 1000])
def test_blocks_equal_one_window(spark, block):
    rows = sequences.pitch_order(ordered(spark, 300, games=7))
    got = {r["idx"]: r for r in sequences.windows(rows, ("v",), "v", limit=None, block=block).collect()}
    values = [r["v"] for r in rows.orderBy("idx").collect()]
    assert sorted(got) == list(range(5, 300))
    assert all([got[k][f"v_{j}"] for j in range(1, 6)] == values[k - 5 : k] and got[k]["label"] == values[k] for k in got)


def test_no_single_partition_window_over_pitches(spark):
    rows = spark.createDataFrame([(1, 1, 1)], "game_pk long, at_bat_number long, pitch_number long")
    plan = sequences.pitch_order(rows)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x.strip() for x in plan.splitlines() if x.strip().lstrip(":+- ").startswith("Window ")]
    numbered, summed = [x for x in windows if "row_number" in x], [x for x in windows if "sum(" in x]
    assert len(numbered) == len(summed) == 1 and "windowspecdefinition(game_pk" in numbered[0]  # pitches within a game, offsets over games
    below = plan[plan.index(summed[0]) :].splitlines()[1:4]
    assert any("Aggregate" in x for x in below)


def test_sample_is_bounded_and_a_subset(spark):
    rows = clean.valid_pitches(fixtures.world(spark, DATA)["pitches"])
    sample = charts.location_sample(rows, most=20)
    assert sample.groupBy("pitcher").count().agg(F.max("count")).first()[0] == 20
    assert sample.join(rows, ["game_pk", "at_bat_number", "pitch_number"], "left_anti").count() == 0


def test_lstm_against_scalars():
    w = scoring.random_weights(2, 3, 4, seed=1)
    x = np.random.default_rng(2).normal(size=(1, 5, 2))
    s = lambda v: 1 / (1 + math.exp(-v))
    steps = [list(step) for step in x[0]]
    for k in range(2):
        h, c, out = [0.0] * 3, [0.0] * 3, []
        for step in steps:
            g = [sum(w[f"weight_ih_l{k}"][r][j] * step[j] for j in range(len(step))) + sum(w[f"weight_hh_l{k}"][r][j] * h[j] for j in range(3)) for r in range(12)]
            c = [s(g[3 + j]) * c[j] + s(g[j]) * math.tanh(g[6 + j]) for j in range(3)]
            h = [s(g[9 + j]) * math.tanh(c[j]) for j in range(3)]
            out.append(h)
        steps = out
    logits = [sum(w["fc_weight"][r][j] * steps[-1][j] for j in range(3)) for r in range(4)]
    e = [math.exp(v) for v in logits]
    assert np.allclose(scoring.forward(x, w)[0], [v / sum(e) for v in e])


def test_predictions(spark):
    probabilities = spark.createDataFrame([(1, "L", 0, 0, c, t, p) for c, (t, p) in enumerate([("CH", 0.3), ("EP", 0.3), ("FF", 0.005), ("SL", 0.395)])], "pitcher long, batter_stand string, balls int, strikes int, code int, pitch_type string, probability double")
    best = scoring.top_predictions(probabilities, k=3)
    assert [(r["rank"], r["pitch_type"], r["percent"]) for r in best.orderBy("rank").collect()] == [(1, "SL", 39.5), (2, "CH", 30.0), (3, "EP", 30.0)]
    types = spark.createDataFrame([(1, "CU"), (1, "CH")], "pitcher long, pitch_type string")
    contexts = probabilities.select(*scoring.CONTEXT_KEYS).unionByName(spark.createDataFrame([(1, "R", 0, 0)], "pitcher long, batter_stand string, balls int, strikes int"))
    got = {(r["batter_stand"], r["pitch_type"], r["percent"]) for r in scoring.with_fallback(contexts, best, types).collect()}
    assert got == {("L", "CH", 30.0), ("R", "CH", 99.9)}


def test_drifting_csvs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("game_pk,at_bat_number,pitch_number,game_date,pitcher,release_speed\n1,1,1,2021-04-01,5,90.5\n1,1,2,2021-12-01,5,91\n")
    (tmp_path / "b.csv").write_text("pitcher,game_date,pitch_number,at_bat_number,game_pk,launch_speed,extra\n6,2022-05-01,1,1,2,bad,x\n")
    (tmp_path / "c.csv").write_text("game_pk,at_bat_number,pitch_number,game_date,pitcher\n")
    files = [str(tmp_path / f"{n}.csv") for n in "abc"]
    rows = {(r["game_pk"], r["pitch_number"]): r for r in ingest.read_csvs(spark, files).collect()}
    assert rows[1, 1]["release_speed"] == 90.5 and rows[2, 1]["pitcher"] == 6 and rows[2, 1]["launch_speed"] is None and rows[2, 1]["extra"] == "x"
    table = str(tmp_path / "table")
    plan = {2021: [files[0]], 2022: [files[1]], 2023: [files[2]], 2024: [str(tmp_path / "none.csv")]}
    first = {r["game_year"]: r["status"] for r in landing.land_years(spark, plan, table).collect()}
    assert (first[2021], first[2022], first[2023]) == ("landed", "landed", "empty") and "none.csv" in first[2024]
    assert {r["game_year"]: r["status"] for r in landing.land_years(spark, {2021: [files[0]]}, table).collect()} == {2021: "skipped"}
    assert {r["game_year"]: r["n"] for r in ingest.table_stats(spark.read.parquet(table)).collect()} == {2021: 1, 2022: 1}
    with pytest.raises(FileNotFoundError):
        ingest.read_csvs(spark, [])


def test_stream_lands_each_file_once(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("source", "table", "checkpoint"))
    w = fixtures.world(spark, DATA)["pitches"]
    rows = ingest.typed(w).select(*[f.name for f in ingest.SCHEMA])
    rows.where("game_pk < 5").write.parquet(source)
    land_stream(spark, source, table, checkpoint).awaitTermination()
    once = spark.read.parquet(table).count()
    land_stream(spark, source, table, checkpoint).awaitTermination()
    assert spark.read.parquet(table).count() == once == ingest.season_window(rows.where("game_pk < 5")).count()


def test_report(spark):
    w = fixtures.world(spark, DATA)
    rows = report.report(w["pitches"], w["matchup_requests"], w["players"], fixtures.AS_OF).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in rows} == {lookup.SUCCESS: 27, lookup.TOO_FEW: 19, lookup.NO_DATA: 79, lookup.NOT_FOUND: 25}


def test_requests_alike_share_a_window(spark, tmp_path):
    w = fixtures.world(spark, DATA)
    resolved = report.resolve(w["matchup_requests"], w["players"], fixtures.AS_OF).where("start_date > '2000-01-01'")
    again = resolved.unionByName(resolved.withColumn("request_id", F.col("request_id") + 1000))
    ingest.write_table(w["pitches"], str(tmp_path / "table"))
    for pitches in (w["pitches"], spark.read.parquet(str(tmp_path / "table"))):
        rows = lookup.pitches_for_requests(pitches, again).groupBy("request_id").count()
        counts = {r[0]: r[1] for r in rows.collect()}
        assert counts and all(counts[k] == counts[k + 1000] for k in counts if k < 1000)
    assert lookup.windows(again).count() == lookup.windows(resolved).count()


def test_saved_models_score_alike(spark, tmp_path):
    rows = clean.training_rows(fixtures.world(spark, DATA)["pitches"]).cache()
    dataset = sequences.sequence_dataset(rows).cache()
    codes = sequences.label_codes(rows)
    encoders = bundles.Encoders.of(codes, sequences.scaler_stats(sequences.encoded(rows, codes)))
    n = encoders.num_classes
    model = models.train_sequence_model(dataset, hidden=8, iterations=5, classes=n)
    bundles.publish(spark, f"file://{tmp_path}/m", bundles.Bundle("perceptron", encoders, model))
    loaded = bundles.load(spark, f"file://{tmp_path}/m").model
    assert sorted(models.predictions(model, dataset).collect()) == sorted(models.predictions(loaded, dataset).collect())
    weights = scoring.train_readout(dataset, n, hidden=8, iterations=5)
    scoring.save_weights(weights, f"file://{tmp_path}/w/weights.npz")
    again = scoring.load_weights(f"file://{tmp_path}/w/weights.npz")
    assert set(again) == set(weights) and all((again[k] == weights[k]).all() for k in weights)
    scored = scoring.lstm_score(dataset, again, "idx", "label").collect()
    assert len(scored) == dataset.na.drop(subset=scoring.INPUTS).count() and all(len(r["probabilities"]) == n for r in scored[:20])


def test_models_learn_what_is_there_to_learn(spark):
    """The next code follows from the speed of the pitch before it; both networks find that on windows held out."""
    x = np.random.default_rng(4).normal(size=(3000, len(scoring.INPUTS)))
    label = (x[:, scoring.INPUTS.index("release_speed_5")] > 0).astype(int) + (x[:, scoring.INPUTS.index("plate_x_5")] > 1)
    rows = spark.createDataFrame([(k, int(y), *map(float, v)) for k, (y, v) in enumerate(zip(label, x, strict=True))], ["idx", "label", *scoring.INPUTS])
    learned, judged = models.held_out(rows)
    losses = models.log_losses(models.train_sequence_model(learned, hidden=8, iterations=60), learned, judged).first()
    assert losses["held_out_loss"] < 0.6 * losses["prior_loss"]
    scored = scoring.lstm_score(judged, scoring.train_readout(learned, 4, hidden=32), "idx", "label").collect()
    fitted = -sum(math.log(r["probabilities"][r["label"]]) for r in scored) / len(scored)
    assert fitted < 0.8 * losses["prior_loss"] and all(r["probabilities"][3] < 1e-6 for r in scored)


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfgame_pk,"odd, name",pitcher\n1,x,5\n')
    (tmp_path / "b.csv").write_text("")
    found = ingest.headers(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert found == {str(tmp_path / "a.csv"): ("game_pk", "odd, name", "pitcher")}
    assert ingest.read_csvs(spark, [str(tmp_path / "a.csv")]).select("game_pk", "pitcher", "odd, name").collect() == [(1, 5, "x")]


def test_a_table_that_cannot_be_read_stops_the_landing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("game_pk,at_bat_number,pitch_number,game_date,pitcher\n1,1,1,2021-04-01,5\n")
    (tmp_path / "table").mkdir()
    (tmp_path / "table" / "part-0.parquet").write_text("not a table")
    with pytest.raises(Exception, match="parquet|CANNOT_READ"):
        landing.land_years(spark, {2021: [str(tmp_path / "a.csv")]}, str(tmp_path / "table"))


def test_rates_by_hand(spark):
    rows = spark.createDataFrame(
        [(1, "FF", "L", d, e, s, v, 90.0) for d, e, s, v in [("swinging_strike", None, 0, None), ("foul", None, 1, None), ("foul_tip", None, 2, None), ("swinging_strike_blocked", "strikeout", 2, None), ("hit_into_play", "single", 2, 95.0), ("hit_into_play", "field_out", 0, 94.9), ("hit_into_play", "field_out", 0, None), ("ball", "strikeout", 1, None), ("called_strike", "strikeout_double_play", 2, None)]],
        "pitcher long, pitch_type string, stand string, description string, events string, strikes int, launch_speed double, release_speed double",
    )
    r = outcomes.outcome_stats(rows).first()
    assert (r["sample_size"], r["avg_speed"], r["whiff_rate"], r["put_away_rate"], r["hard_hit_rate"]) == (9, 90.0, 28.6, 50.0, 50.0)  # 2 of 7, 2 of 4, 1 of 2
    flags = outcomes.outcome_flags(outcomes.outcome_stats(rows)).first()
    assert (flags["high_whiff"], flags["high_put_away"]) == (False, True)


def test_context_model(spark):
    rows = fixtures.world(spark, DATA)["pitches"].where("pitch_type IS NOT NULL").select("pitch_type", *models.CONTEXT)
    model = models.train_context_model(rows, trees=2)
    ready = models.context_rows(rows.limit(50).withColumn("pitcher_class", F.lit("other")))
    p = [r["probabilities"] for r in models.class_probabilities(model, ready).collect()]
    assert all(abs(sum(x) - 1) < 1e-9 for x in p)


def test_rare_pitchers_share_a_class(spark):
    rows = fixtures.world(spark, DATA)["pitches"].where("pitch_type IS NOT NULL").select("pitch_type", *models.CONTEXT).cache()
    model = models.train_context_model(rows, trees=5, pitchers=8)
    frequent = [x for x in model.stages[0].labelsArray[0] if x != "other"]
    asked = models.context_rows(rows.where(~F.col("pitcher").cast("string").isin(frequent)).distinct().withColumn("pitcher_class", F.col("pitcher").cast("string")))
    asked = asked.unionByName(asked.limit(1).withColumns({"pitcher": F.lit(-1).cast("long"), "pitcher_class": F.lit("-1")})).drop("pitch_type").withColumn("pitch_type", F.lit("FF"))
    by = ["pitcher", "stand", "balls", "strikes", "outs_when_up", "inning"]
    got = models.class_probabilities(model, asked).select(*by, "probabilities").distinct().orderBy(by).collect()
    learned = model.transform(asked.withColumn("pitcher_class", F.lit("other"))).withColumn("probabilities", vector_to_array("probability"))
    assert len(frequent) == 7 and len(got) > 100
    assert got == learned.select(*by, "probabilities").distinct().orderBy(by).collect()


def test_constants():
    assert len(C.VALID_ARSENAL) == len(C.PITCH_NAMES) == 12 and len(C.RUN_CENTS) == 16
