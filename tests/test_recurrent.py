"""The recurrent network: gradients, training on ordered steps, what a lost task costs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundworks.functions.constants import FEATURES, SEQUENCE
from moundworks.operators import recurrent, scoring


def test_gradients_by_finite_differences():
    random = np.random.default_rng(3)
    weights = recurrent.first_weights(4, 5, 3)
    x, labels = random.normal(size=(6, 5, 4)), np.array([0, 1, 2, 2, 1, 0])
    loss, grads = recurrent.loss_and_gradients(x, labels, weights)
    assert loss == pytest.approx(-np.log(scoring.forward(x, weights)[np.arange(6), labels]).mean())
    assert set(grads) == set(weights)
    for name, w in weights.items():
        for at in [tuple(random.integers(0, s) for s in w.shape) for _ in range(6)]:
            ends = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in weights.items()}
                moved[name][at] += step
                ends.append(recurrent.loss_and_gradients(x, labels, moved)[0])
            assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-8), name


def ordered_windows(spark, n, seed):
    """The label says whether the largest speed came before the largest x: only the order of steps tells."""
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, SEQUENCE, len(FEATURES)))
    labels = (x[:, :, 0].argmax(axis=1) < x[:, :, 1].argmax(axis=1)).astype(int)
    rows = [(k, int(y), *map(float, v.ravel())) for k, (v, y) in enumerate(zip(x, labels, strict=True))]
    return spark.createDataFrame(rows, "idx long, label int, " + ", ".join(f"{c} double" for c in scoring.INPUTS))


def test_order_of_steps_is_learned(spark):
    learned, judged = ordered_windows(spark, 3000, 1).cache(), ordered_windows(spark, 600, 2)
    weights, losses = recurrent.train(learned, 2, hidden=16, epochs=12, workers=2, batch=64, rate=0.01)
    assert losses[-1] < losses[0] - 0.1
    loss = lambda w: recurrent.held_out_loss(judged, w).first()[0]
    assert loss(weights) < loss(scoring.train_readout(learned, 2, hidden=16)) - 0.1


def test_workers_hold_the_same_weights_and_a_lost_task_repeats_the_epoch(spark, tmp_path, monkeypatch):
    rows = recurrent.dealt(ordered_windows(spark, 200, 4), 2).repartition(2, "worker")
    first = recurrent.first_weights(len(FEATURES), 6, 2)
    made = [recurrent.unpacked(r["weights"]) for r in recurrent.epoch(rows, first, None, 0, 32, 0.01, 3, 7).collect()]
    assert len(made) == 2 and all((made[0][k] == made[1][k]).all() for k in first)
    flag, average = str(tmp_path / "failed"), recurrent.averaged

    def fails_once(context, weights, n):
        if context.partitionId() == 1 and not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("a worker is lost")
        return average(context, weights, n)

    monkeypatch.setattr(recurrent, "averaged", fails_once)
    again = [recurrent.unpacked(r["weights"]) for r in recurrent.epoch(rows, first, None, 0, 32, 0.01, 3, 7).collect()]
    assert os.path.exists(flag) and all((again[0][k] == made[0][k]).all() for k in first)


def test_few_or_no_windows(spark):
    some = ordered_windows(spark, 1, 5)
    weights, losses = recurrent.train(some, 2, hidden=4, epochs=2, workers=3)
    assert len(losses) == 2 and all(np.isfinite(v).all() for v in weights.values())
    weights, losses = recurrent.train(some.where("false"), 2, hidden=4, epochs=2, workers=3)
    assert losses == [] and (weights["fc_bias"] == recurrent.first_weights(len(FEATURES), 4, 2)["fc_bias"]).all()
    holes = some.unionByName(ordered_windows(spark, 20, 6).withColumn(scoring.INPUTS[3], F.lit(None).cast("double")))
    assert recurrent.dealt(holes, 1).select(F.octet_length("labels")).first()[0] == 4
