"""Units land whole and once, whatever fails and however often jobs run."""

import pytest
from pyspark.sql import functions as F

from moundworks.sources import ingest, landing
from moundworks.streaming import landing as streams

HEADER = "game_pk,at_bat_number,pitch_number,game_date,pitcher"


def pitches(spark, year, games, month=5):
    rows = [(g, 1, k, f"{year}-{month:02d}-01", 7) for g in games for k in range(3)]
    return ingest.season_window(ingest.typed(spark.createDataFrame(rows, "game_pk long, at_bat_number long, pitch_number long, game_date string, pitcher long")))


def keys(table):
    return sorted(tuple(r) for r in table.select("game_year", "game_pk", "pitch_number").collect())


def test_a_unit_lands_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert landing.read_table(spark, path).count() == 0
    assert landing.land(pitches(spark, 2021, range(4)), path, "a") == 12
    assert landing.land(pitches(spark, 2021, range(4)), path, "a") is None
    both = pitches(spark, 2021, [9]).unionByName(pitches(spark, 2022, [1]))
    assert landing.land(both, path, "b") == 6
    assert keys(landing.read_table(spark, path)) == sorted([(2021, g, k) for g in (0, 1, 2, 3, 9) for k in range(3)] + [(2022, 1, k) for k in range(3)])
    assert keys(landing.read_table(spark, path, (2022,))) == [(2022, 1, k) for k in range(3)]
    listed = landing.manifest(spark, path).collect()
    assert sum(f["n"] for r in listed for f in r["files"]) == sum(r["n_rows"] for r in listed) == 18
    assert landing.land(pitches(spark, 2021, []), path, "none") == 0 and landing.land(pitches(spark, 2021, [5]), path, "none") is None


def test_what_fails_half_way_is_not_there(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    landing.land(pitches(spark, 2021, range(2)), path, "a")
    broken = pitches(spark, 2022, range(40)).withColumn("pitcher", F.when(F.col("game_pk") > 20, F.raise_error(F.lit("broke off")).cast("long")).otherwise(F.col("pitcher")))
    with pytest.raises(Exception, match="broke off"):
        landing.land(broken, path, "b")
    assert landing.read_table(spark, path).count() == 6
    # all is written, then the driver is lost before it publishes
    with monkeypatch.context() as m:
        m.setattr(F, "sort_array", lambda c: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            landing.land(pitches(spark, 2022, range(40)), path, "b")
    assert landing.read_table(spark, path).count() == 6 and len(landing.unlisted(spark, path)) == 1
    assert landing.land(pitches(spark, 2022, range(40)), path, "b") == 120
    assert landing.read_table(spark, path).count() == 126 == landing.read_table(spark, path).select("game_pk", "pitch_number", "game_year").distinct().count()


def test_a_unit_published_twice_counts_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    landing.land(pitches(spark, 2021, range(2)), path, "a")
    row = spark.read.schema(landing.MANIFEST).parquet(f"{path}/_manifest").collect()
    landing.land(pitches(spark, 2021, range(2)), path, "other job")
    late = spark.read.schema(landing.MANIFEST).parquet(f"{path}/_manifest").where("unit = 'other job'").withColumn("unit", F.lit("a")).collect()
    spark.createDataFrame([*row, *late], landing.MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/_other")
    spark.read.parquet(f"{path}/_other").coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")
    assert landing.read_table(spark, path).count() == 6 and len(landing.unlisted(spark, path)) == 1


def test_a_table_of_another_kind_is_refused(spark, tmp_path):
    ingest.write_table(pitches(spark, 2021, [1]), f"file://{tmp_path}/t")
    with pytest.raises(ValueError, match="without a manifest"):
        landing.land(pitches(spark, 2022, [1]), f"file://{tmp_path}/t", "a")


def test_csv_stream_with_drifting_headers(spark, tmp_path, monkeypatch):
    source, table, checkpoint = (f"file://{tmp_path}/{n}" for n in ("source", "table", "checkpoint"))
    (tmp_path / "source").mkdir()
    (tmp_path / "source/a.csv").write_text(f"{HEADER}\n1,1,1,2021-04-01,5\n1,1,2,2021-12-01,5\n")
    (tmp_path / "source/b.csv").write_text("pitcher,extra,game_date,pitch_number,at_bat_number,game_pk\n6,x,2022-05-01,1,1,2\n")
    publish, lost = landing.land, []

    def fails_after(new, path, unit):
        found = publish(new, path, unit)
        if not lost:
            lost.append(unit)
            raise RuntimeError("the driver is lost after publishing")
        return found

    monkeypatch.setattr(streams, "land", fails_after)
    with pytest.raises(Exception, match="lost after publishing"):
        streams.land_csv_stream(spark, source, table, checkpoint).awaitTermination()
    streams.land_csv_stream(spark, source, table, checkpoint).awaitTermination()  # the same batch again
    assert keys(landing.read_table(spark, table)) == [(2021, 1, 1), (2022, 2, 1)]
    (tmp_path / "source/c.csv").write_text(f"{HEADER}\n3,1,1,2022-04-01,5\n")
    streams.land_csv_stream(spark, source, table, checkpoint).awaitTermination()
    rows = landing.read_table(spark, table)
    assert keys(rows) == [(2021, 1, 1), (2022, 2, 1), (2022, 3, 1)] and {r["extra"] for r in rows.collect()} == {None, "x"}
