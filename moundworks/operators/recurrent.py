"""Training the recurrent network: back-propagation through time on Spark workers, averaged in barrier stages.

The windows lie in a written table, dealt to a fixed number of workers.  An epoch is one barrier stage: each worker holds its
windows as arrays, takes Adam steps on its own batches, and some times an epoch all workers exchange their weights
(``allGather``) and go on from the mean, weighted by their windows.  A stage's result is the common weights and each worker's
optimiser state; it is written, and the next epoch starts from it.  If a task is lost Spark restarts the whole stage (one
that ends in a shuffle, as only those can be restarted), so an epoch is repeated from the state that is written and no
half-done epoch leaves a trace.

The arithmetic is numpy; what a worker holds is its share of the training windows (30 numbers each), bounded by the
training limit and the number of workers, and one network.  Windows with a missing number are left out; a worker without
windows takes no steps and has no weight in the mean; no window at all leaves the first weights.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.functions.constants import FEATURES, SEQUENCE
from moundworks.operators import scoring
from moundworks.operators.scoring import LAYERS, sigmoid
from moundworks.sources.shared import materialise

WORKERS, EPOCHS, BATCH, RATE, SYNCS = 4, 3, 256, 0.003, 4
Weights = dict[str, np.ndarray]


def first_weights(inputs: int, hidden: int, classes: int, seed: int = 7) -> Weights:
    """Uniform in +-1 / sqrt(hidden), the forget gates' bias at 1."""
    random, bound = np.random.default_rng(seed), 1 / np.sqrt(hidden)
    made = {k: random.uniform(-bound, bound, v.shape) for k, v in scoring.random_weights(inputs, hidden, classes).items()}
    for k in range(LAYERS):
        made[f"bias_ih_l{k}"][hidden : 2 * hidden] = 1.0
        made[f"bias_hh_l{k}"][:] = 0.0
    return made


def loss_and_gradients(x: np.ndarray, labels: np.ndarray, weights: Weights) -> tuple[float, Weights]:
    """Mean cross-entropy of a batch (n, steps, features) and its gradient by every weight."""
    n, n_steps = x.shape[:2]
    inputs, kept = np.moveaxis(x, 1, 0), []
    for k in range(LAYERS):
        hidden = weights[f"weight_hh_l{k}"].shape[1]
        h = c = np.zeros((n, hidden), x.dtype)
        steps, out = [], []
        for step in inputs:
            gates = step @ weights[f"weight_ih_l{k}"].T + weights[f"bias_ih_l{k}"] + h @ weights[f"weight_hh_l{k}"].T + weights[f"bias_hh_l{k}"]
            i, f, g, o = np.split(gates, 4, axis=1)
            i, f, g, o = sigmoid(i), sigmoid(f), np.tanh(g), sigmoid(o)
            before, last = c, h
            c = f * c + i * g
            t = np.tanh(c)
            h = o * t
            steps.append((step, last, before, i, f, g, o, t))
            out.append(h)
        kept.append(steps)
        inputs = np.stack(out)
    logits = inputs[-1] @ weights["fc_weight"].T + weights["fc_bias"]
    logits = logits - logits.max(axis=1, keepdims=True)
    log_p = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    d = np.exp(log_p)
    d[np.arange(n), labels] -= 1
    d /= n
    grads = {"fc_weight": d.T @ inputs[-1], "fc_bias": d.sum(axis=0)}
    above = np.zeros_like(inputs)  # by each step's output
    above[-1] = d @ weights["fc_weight"]
    for k in reversed(range(LAYERS)):
        w_in, w_hh = weights[f"weight_ih_l{k}"], weights[f"weight_hh_l{k}"]
        g_in, g_hh, g_bias = np.zeros_like(w_in), np.zeros_like(w_hh), np.zeros_like(weights[f"bias_ih_l{k}"])
        below = np.zeros((n_steps, n, w_in.shape[1]), x.dtype)
        dh = dc = np.zeros((n, w_hh.shape[1]), x.dtype)
        for s in reversed(range(n_steps)):
            step, last, before, i, f, g, o, t = kept[k][s]
            dh = dh + above[s]
            dc = dc + dh * o * (1 - t * t)
            gates = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g * g), dh * t * o * (1 - o)], axis=1)
            g_in += gates.T @ step
            g_hh += gates.T @ last
            g_bias += gates.sum(axis=0)
            below[s], dh, dc = gates @ w_in, gates @ w_hh, dc * f
        grads |= {f"weight_ih_l{k}": g_in, f"weight_hh_l{k}": g_hh, f"bias_ih_l{k}": g_bias, f"bias_hh_l{k}": g_bias}
        above = below
    return float(-log_p[np.arange(n), labels].mean()), grads


class Adam:
    """The optimiser's state beside some weights."""

    def __init__(self, weights: Weights, rate: float = RATE, state: Weights | None = None) -> None:
        self.rate = rate
        self.state = state or {"step": np.zeros(1)} | {f"{m}.{k}": np.zeros_like(v) for k, v in weights.items() for m in "mv"}

    def step(self, weights: Weights, grads: Weights) -> None:
        s = self.state
        s["step"] = s["step"] + 1
        n = float(s["step"][0])
        for k, g in grads.items():
            s[f"m.{k}"] = 0.9 * s[f"m.{k}"] + 0.1 * g
            s[f"v.{k}"] = 0.999 * s[f"v.{k}"] + 0.001 * g * g
            weights[k] = weights[k] - (self.rate * (s[f"m.{k}"] / (1 - 0.9**n)) / (np.sqrt(s[f"v.{k}"] / (1 - 0.999**n)) + 1e-8)).astype(weights[k].dtype)


def packed(arrays: Weights) -> bytes:
    data = io.BytesIO()
    np.savez(data, **arrays)
    return data.getvalue()


def unpacked(data: bytes) -> Weights:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


def averaged(context: BarrierTaskContext, weights: Weights, n: int) -> Weights:
    """The mean of all workers' weights, each counted by its windows."""
    sent = context.allGather(f"{n} " + base64.b64encode(packed(weights)).decode())
    parts = [(int(a), unpacked(base64.b64decode(b))) for a, b in (m.split(" ") for m in sent)]
    whole = sum(a for a, _ in parts)
    return {k: sum(w[k] * np.float32(a / whole) for a, w in parts) for k in weights} if whole else weights


def epoch(rows: DataFrame, weights: Weights, states: DataFrame | None, number: int, batch: int, rate: float, syncs: int, seed: int) -> DataFrame:
    """worker, n, loss, weights, state after one pass over rows (worker, windows, labels: one row a worker)."""
    shared = packed(scoring.narrow(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, mine = BarrierTaskContext.get(), [r for b in batches for r in b.to_pylist()]
        own = unpacked(shared)
        adams = [Adam(own, rate, unpacked(r["state"]) if r.get("state") else None) for r in mine]
        x = [np.frombuffer(r["windows"], np.float32).reshape(-1, SEQUENCE, len(FEATURES)) for r in mine]
        labels = [np.frombuffer(r["labels"], np.int32) for r in mine]
        total, seen = [0.0] * len(mine), sum(len(y) for y in labels)
        orders = [np.random.default_rng([seed, number, r["worker"]]).permutation(len(y)) for r, y in zip(mine, labels, strict=True)]
        for part in range(syncs):
            for k, order in enumerate(orders):
                some = order[len(order) * part // syncs : len(order) * (part + 1) // syncs]
                for start in range(0, len(some), batch):
                    at = some[start : start + batch]
                    loss, grads = loss_and_gradients(x[k][at], labels[k][at], own)
                    adams[k].step(own, grads)
                    total[k] += loss * len(at)
            own = averaged(context, own, seen)
        for r, y, adam, loss in zip(mine, labels, adams, total, strict=True):
            yield pa.RecordBatch.from_pydict({"worker": [r["worker"]], "n": [len(y)], "loss": [loss / max(len(y), 1)], "weights": [packed(own)], "state": [packed(adam.state)]}, schema=RESULT)

    rows = rows.join(states.select("worker", "state"), "worker", "left") if states is not None else rows
    made = rows.mapInArrow(run, "worker int, n long, loss double, weights binary, state binary", barrier=True)
    return made.repartition(1)  # a row per worker; Spark restarts a barrier stage only if it ends in a shuffle


RESULT = pa.schema([("worker", pa.int32()), ("n", pa.int64()), ("loss", pa.float64()), ("weights", pa.binary()), ("state", pa.binary())])


def dealt(dataset: DataFrame, workers: int) -> DataFrame:
    """worker, windows, labels: the complete windows of a dataset in one row per worker."""
    rows = scoring.windows_of(dataset, F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("idx"), F.lit(workers)).cast("int").alias("worker"))

    def run(table: pa.Table) -> pa.Table:
        windows = table.column("window").combine_chunks().flatten().to_numpy().astype(np.float32)
        return pa.table({"worker": [table.column("worker")[0].as_py()], "windows": [windows.tobytes()], "labels": [table.column("label").to_numpy().astype(np.int32).tobytes()]}, schema=pa.schema([("worker", pa.int32()), ("windows", pa.binary()), ("labels", pa.binary())]))

    ordered = rows.groupBy("worker").applyInArrow(run, "worker int, windows binary, labels binary")  # the training limit's share
    return materialise(ordered, "dealt")


def train(dataset: DataFrame, classes: int, hidden: int = scoring.HIDDEN, epochs: int = EPOCHS, workers: int = WORKERS, batch: int = BATCH, rate: float = RATE, syncs: int = SYNCS, seed: int = 7) -> tuple[Weights, list[float]]:
    """Weights learned from windows (idx, label, INPUTS), and the mean training loss of each epoch.

    All workers of a barrier stage run at once, so there must be as many free cores as workers.
    """
    rows = dealt(dataset, workers)
    rows = rows.repartition(workers, "worker") if rows.sparkSession.sparkContext.defaultParallelism >= workers else rows.coalesce(1)
    weights, states, losses = first_weights(len(FEATURES), hidden, classes, seed), None, []
    for number in range(epochs):
        states = materialise(epoch(rows, weights, states, number, batch, rate, syncs, seed), "epoch")
        done = states.orderBy("worker").select("n", "loss").collect()  # a row per worker
        if not done:
            break
        losses.append(sum(r["n"] * r["loss"] for r in done) / max(sum(r["n"] for r in done), 1))
        weights = unpacked(states.where(F.col("n") > 0).orderBy("worker").select("weights").first()[0])
    return weights, losses


def held_out_loss(judged: DataFrame, weights: Weights) -> DataFrame:
    """One row: mean negative log-likelihood of the labels of windows."""
    scored = scoring.lstm_score(judged, weights, "label")
    likely = F.get("probabilities", F.col("label").cast("int"))
    return scored.agg(F.avg(-F.log(F.greatest(likely, F.lit(1e-12)))).alias("held_out_loss"))
