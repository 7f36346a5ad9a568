"""Bundles: round trips, versions, and parts that do not belong together."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundworks.functions.constants import FEATURES
from moundworks.operators import bundles, recurrent
from moundworks.plans import queries
from moundworks.sources import fixtures

DATA = "/root/testdata/sf0.001"
ENCODERS = bundles.Encoders(("CH", "FF", "SL"), ("L", "R", None), tuple(map(float, range(6))), (1.0, 2.0, None, 1.0, 1.0, 0.5))


def network(seed=1, classes=3):
    return recurrent.first_weights(len(FEATURES), 4, classes, seed)


def test_round_trip_and_versions(spark, tmp_path):
    root = f"file://{tmp_path}/b"
    assert bundles.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        bundles.load(spark, root)
    first, second = (bundles.Bundle("recurrent", ENCODERS, network(k)) for k in (1, 2))
    assert [bundles.publish(spark, root, b) for b in (first, second)] == [1, 2]
    found = bundles.load(spark, root, ("CH", "FF", "SL"))
    assert found.encoders == ENCODERS and found.digest == second.digest != first.digest
    assert all((found.model[k] == v).all() and found.model[k].dtype == v.dtype for k, v in second.model.items())
    codes = {(r["kind"], r["value"]): r["code"] for r in found.encoders.codes(spark).collect()}
    assert codes["pitch_type", "SL"] == 2 and codes["stand", None] == 2
    assert bundles.Encoders.of(found.encoders.codes(spark), found.encoders.stats(spark)) == ENCODERS


def test_a_half_written_version_is_not_in_use(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/b"
    bundles.publish(spark, root, bundles.Bundle("recurrent", ENCODERS, network(1)))
    digest = bundles.load(spark, root).digest

    def fails(spark, root):
        raise RuntimeError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(bundles, "current", fails)
        with pytest.raises(RuntimeError):
            bundles.publish(spark, root, bundles.Bundle("recurrent", ENCODERS, network(2)))
    assert bundles.load(spark, root).digest == digest


def test_mismatched_parts_are_refused(spark, tmp_path):
    root = f"file://{tmp_path}/b"
    for wrong in ({"classes": ("CH", "FF")}, {"features": FEATURES[:5]}, {"means": (1.0,)}):
        with pytest.raises(bundles.Mismatch):
            bundles.Bundle("recurrent", dataclasses.replace(ENCODERS, **wrong), network())
    with pytest.raises(bundles.Mismatch):
        bundles.Bundle("forest", ENCODERS, network())
    with pytest.raises(bundles.Mismatch):
        bundles.Bundle("recurrent", ENCODERS, network() | {"weight_ih_l0": np.zeros((16, 7))})
    bundles.publish(spark, root, bundles.Bundle("recurrent", ENCODERS, network(1)))
    with pytest.raises(bundles.Mismatch, match="classes"):
        bundles.load(spark, root, ("FF", "CH", "SL"))
    folder = bundles.current(spark, root)[1]
    other = f"file://{tmp_path}/c"
    bundles.publish(spark, other, bundles.Bundle("recurrent", ENCODERS, network(2)))
    stolen = spark.read.parquet(f"{other}/{bundles.current(spark, other)[1]}/weights").withColumn("data", F.col("data"))
    stolen.write.mode("overwrite").parquet(f"{root}/{folder}/weights")  # the weights of another training
    with pytest.raises(bundles.Mismatch, match="one training"):
        bundles.load(spark, root)


def test_predictions_load_and_do_not_train(spark, monkeypatch):
    w = fixtures.world(spark, DATA)
    weights = recurrent.first_weights(len(FEATURES), 8, 13)
    classes = ("CH", "CU", "EP", "FC", "FF", "FS", "KC", "KN", "PO", "SI", "SL", "ST", "SV")
    encoders = bundles.Encoders(classes, ("L", "R", None), (90.0, 0.0, 2.5, 1.0, 1.0, 0.5), (5.0, 1.0, 1.0, 1.0, 1.0, 0.5))
    root = queries.next_pitch(w)
    bundles.publish(spark, root, bundles.Bundle("recurrent", encoders, weights))

    def trains(*_, **__):
        raise AssertionError("a published network is used as it is")

    monkeypatch.setattr(recurrent, "train", trains)
    rows = queries.QUERIES["predict_context"](spark, DATA).collect()
    assert rows and {r["pitch_type"] for r in rows} <= set(classes)
    assert queries.QUERIES["lstm_score"](spark, DATA).count() > 1000
