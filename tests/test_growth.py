"""What one task holds is bounded by rows, not by the table; results do not depend on the number of partitions."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundworks.functions import expressions as E
from moundworks.operators import backoff, charts, kinematics, models, scoring, sequences
from moundworks.plans.queries import QUERIES, clean_rows, in_inches
from moundworks.sources import fixtures, ingest, shared

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def digest(rows):
    return rows.agg(F.count("*"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)"))).first()


def largest(rows):
    """Rows of the fullest partition, and the partitions."""
    counts = rows.rdd.mapPartitions(lambda some: [sum(1 for _ in some)]).collect()
    return max(counts), len(counts)


def test_a_partition_of_the_pitch_world_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 300)
    (small, few), (large, many) = (largest(fixtures.world(spark, f"/root/testdata/{sf}")["pitches"].select("game_pk", "pitch_number")) for sf in ("sf0.001", "sf0.01"))
    assert small < 600 > large and many == pytest.approx(10 * few, rel=0.1)


def test_partitions_are_not_joined_where_the_session_has_many(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 1000)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        pitches = fixtures.world(spark, "/root/testdata/sf0.01")["pitches"]
        (world, many), (games, _) = (largest(rows.select("game_pk", "pitch_number")) for rows in (pitches, shared.spread(pitches, "game_pk")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert many == 60 and world < 2000 and games < 4000  # a game has some 256 pitches


@pytest.mark.parametrize(("rows", "parts"), [(400, 150), (100, 200), (30, 400)])
def test_rows_are_dealt_without_a_sort_while_partitions_are_bounded(spark, monkeypatch, rows, parts):
    monkeypatch.setattr(shared, "ROWS", rows)
    fullest, many = largest(fixtures.world(spark, "/root/testdata/sf0.01")["pitches"].select("game_pk", "pitch_number"))
    assert many == parts and fullest < 2 * 60_000 / parts  # Spark writes to 200 partitions without sorting


def test_games_are_dealt_without_a_sort(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 10)
    rows = fixtures.world(spark, DATA)["pitches"].select(*sequences.ORDER)
    assert shared.spread(rows, "game_pk").rdd.getNumPartitions() == 200


def test_a_year_is_dealt_without_a_sort(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 10)
    assert fixtures.of_year(fixtures.world(spark, DATA), 2022).select("game_pk", "pitch_number").rdd.getNumPartitions() == 200


@pytest.mark.parametrize("name", ["valid_pitches", "pitch_sequences", "pitch_sequences_by_pitcher_game", "training_limit", "ingest_incremental"])
def test_results_do_not_depend_on_partitions(spark, monkeypatch, name):
    want = digest(QUERIES[name](spark, DATA))
    monkeypatch.setattr(shared, "ROWS", 300)
    assert digest(QUERIES[name](spark, DATA)) == want


@pytest.mark.parametrize(("made", "shape"), [(kinematics.trajectory, E.FREE), (kinematics.trajectory_to_plate, E.TO_PLATE)])
def test_points_are_those_of_the_sql_without_an_interpreted_loop(spark, made, shape):
    rows = made(in_inches(clean_rows(fixtures.world(spark, DATA))), 7)
    parts = ", ".join(f"'{k}', {v.format(**kinematics.NAMES, t='(i / 7e0 * flight)')}" for k, v in shape.items())
    want = F.expr(f"transform(sequence(0, 7), i -> named_struct('i', i, {parts}))")
    as_text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})  # noqa: E731  # -0.0 and 0.0 differ
    assert rows.where(as_text("points") != as_text(want)).count() == 0 < rows.where(F.exists("points", lambda p: p.x.isNull())).count()
    assert rows.where(F.size("points") == 8).count() == rows.count()
    assert "lambda" not in rows.select("points")._jdf.queryExecution().optimizedPlan().toString()


def test_a_sample_sorts_little_more_than_it_keeps(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("game_pk"), (F.col("id") % 9).alias("at_bat_number"), F.lit(1).alias("pitch_number"))
    rows = rows.withColumn("pitcher", F.when(F.col("k") > 0, 1)).withColumn("game_pk", F.when(F.col("k") < 2, F.col("game_pk")).otherwise(-F.col("game_pk")))
    rows = rows.unionByName(rows.limit(5).withColumn("game_pk", F.lit(None).cast("long"))).cache()  # a hot key, a null one, no game, orders below 0
    found = charts.location_sample(rows, most=500)
    order = Window.partitionBy("pitcher").orderBy(F.expr(charts.SAMPLE_ORDER), "game_pk", "at_bat_number", "pitch_number")
    want = rows.withColumn("_r", F.row_number().over(order)).where("_r <= 500").drop("_r")
    assert found.count() == 1000 and digest(found) == digest(want)
    assert "_salt" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_hot_pitcher_is_split_by_bytes_when_a_table_is_written(spark, tmp_path):
    pitches = fixtures.world(spark, DATA)["pitches"].withColumns({"pitcher": F.lit(1).cast("long"), "game_pk": F.lit(8).cast("long")}).repartition(6)
    was = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "60k")
        ingest.write_table(pitches, f"file://{tmp_path}/t")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)
    table = spark.read.parquet(f"file://{tmp_path}/t")
    files = table.groupBy("game_year", F.input_file_name()).count()
    assert table.count() == pitches.count() and files.groupBy("game_year").count().agg(F.min("count")).first()[0] > 1


def test_forests_learn_from_cases_not_from_pitches(spark):
    rows = fixtures.world(spark, DATA)["pitches"].where("pitch_type IS NOT NULL").limit(2000).cache()
    twice = models.cases(rows.unionByName(rows))
    assert twice.agg(F.sum("n")).first()[0] == 4000 and twice.count() == models.cases(rows).count()
    classes = backoff.pitch_classes(rows)
    assert digest(backoff.class_counts(models.cases(rows, "game_pk"), classes)) == digest(backoff.class_counts(rows, classes))


def test_scoring_in_pieces(monkeypatch):
    x, weights = np.random.default_rng(1).normal(size=(1000, 5, 6)), scoring.random_weights(6, 16, 4)
    monkeypatch.setattr(scoring, "PIECE", 2000)
    want = scoring.forward(x, weights)
    monkeypatch.setattr(scoring, "PIECE", 7)
    assert np.allclose(scoring.forward(x, weights), want, atol=1e-12) and len(want) == 1000
