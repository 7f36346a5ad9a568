"""Predictions: the recurrent network's forward pass, top-k, and what a pitcher's arsenal leaves of them."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundworks.functions.constants import FEATURES, MIN_PROBABILITY, SEQUENCE, TOP_K
from moundworks.functions.expressions import rounded
from moundworks.sources.shared import materialise

CONTEXT_KEYS = ("pitcher", "batter_stand", "balls", "strikes")
INPUTS = [f"{c}_{k}" for k in range(1, SEQUENCE + 1) for c in FEATURES]
LAYERS, HIDDEN = 2, 128
PIECE = 256  # windows scored at a time
UNSEEN = -30.0  # bias of a class without a training row


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def in_place_sigmoid(x: np.ndarray) -> None:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def random_weights(inputs: int, hidden: int, classes: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Untrained weights of the right shapes (names and gate order i, f, g, o as common exports have them)."""
    random = np.random.default_rng(seed)
    made = {}
    for k in range(LAYERS):
        made |= {f"weight_ih_l{k}": random.normal(0, 0.1, (4 * hidden, inputs if k == 0 else hidden)), f"weight_hh_l{k}": random.normal(0, 0.1, (4 * hidden, hidden))}
        made |= {f"bias_ih_l{k}": np.zeros(4 * hidden), f"bias_hh_l{k}": np.zeros(4 * hidden)}
    return made | {"fc_weight": random.normal(0, 0.1, (classes, hidden)), "fc_bias": np.zeros(classes)}


def last_states(x: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """The second layer's output after the last step of a batch (n, steps, features), from a zero start."""
    steps = list(np.moveaxis(x, 1, 0))
    for k in range(LAYERS):
        w_in, w_hh, bias = weights[f"weight_ih_l{k}"].T, weights[f"weight_hh_l{k}"].T, weights[f"bias_ih_l{k}"] + weights[f"bias_hh_l{k}"]
        hidden, out = len(w_hh), []
        for number, step in enumerate(steps):
            gates = step @ w_in
            gates += bias
            if number:
                gates += out[-1] @ w_hh
            i, f, g, o = np.split(gates, 4, axis=1)
            for part in (gates[:, : 2 * hidden], o):
                in_place_sigmoid(part)
            np.tanh(g, out=g)
            i *= g
            c = f * c + i if number else i
            h = np.tanh(c)
            h *= o
            out.append(h)
        steps = out
    return steps[-1]


def forward(x: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Class probabilities of a batch: two recurrent layers, last step, linear, softmax; in pieces that stay in a core's cache."""
    if len(x) > PIECE:
        return np.concatenate([forward(x[k : k + PIECE], weights) for k in range(0, len(x), PIECE)])
    logits = last_states(x, weights) @ weights["fc_weight"].T + weights["fc_bias"]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def save_weights(weights: dict[str, np.ndarray], path: str) -> None:
    """Write weights as an ``.npz`` to a shared folder, under the names of ``random_weights``."""
    fs, name = pafs.FileSystem.from_uri(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    data = io.BytesIO()
    np.savez(data, **weights)
    with fs.open_output_stream(name) as out:
        out.write(data.getvalue())


def load_weights(path: str) -> dict[str, np.ndarray]:
    """Weights from an ``.npz``: those of ``save_weights``, or of a network trained elsewhere under the same names."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name) as source:
        stored = np.load(io.BytesIO(source.read()))
        return {k: stored[k] for k in stored.files}


def batches_of(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["window"].to_numpy()).astype(np.float32).reshape(-1, SEQUENCE, len(FEATURES)) if len(batch) else np.zeros((0, SEQUENCE, len(FEATURES)), np.float32)


def windows_of(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and the complete windows' numbers as one array column."""
    return rows.na.drop(subset=INPUTS).select(*keys, F.array(*[F.col(c).cast("float") for c in INPUTS]).alias("window"))


def narrow(weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: v.astype(np.float32) for k, v in weights.items()}


def train_readout(rows: DataFrame, classes: int, hidden: int = HIDDEN, iterations: int = 20, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights of a network whose recurrent layers are fixed random features and whose linear layer is fit by Spark ML.

    rows: windows with INPUTS and label.  States are computed in batches; the multinomial regression over them is Spark's.
    """
    weights = random_weights(len(FEATURES), hidden, classes, seed)
    shared = rows.sparkSession.sparkContext.broadcast(narrow(weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "state": list(last_states(batches_of(batch), shared.value).astype(float))})

    states = windows_of(rows, F.col("label").cast("double").alias("label")).mapInPandas(run, "label double, state array<double>")
    ready = materialise(states, "states").select("label", array_to_vector("state").alias("features"))
    fit = LogisticRegression(maxIter=iterations, family="multinomial", regParam=1e-4).fit(ready)
    found = fit.coefficientMatrix.toArray()
    seen = {r[0] for r in ready.select(F.col("label").cast("int")).distinct().collect()}  # a row per class
    weights["fc_weight"][: len(found)], weights["fc_weight"][len(found) :] = found, 0.0
    weights["fc_bias"] = np.array([fit.interceptVector[k] if k in seen else UNSEEN for k in range(classes)])
    return weights


def lstm_score(rows: DataFrame, weights: dict[str, np.ndarray], *keys: str) -> DataFrame:
    """keys and probabilities (by code) of windows with the columns INPUTS; incomplete windows are left out.

    The weights are some hundred kB, broadcast once; scoring is batched matrix arithmetic on Arrow batches.
    """
    shared = rows.sparkSession.sparkContext.broadcast(narrow(weights))
    ready = windows_of(rows, *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("window").flatten().to_numpy(zero_copy_only=False).reshape(-1, SEQUENCE, len(FEATURES))
            found = forward(x, shared.value).astype(float)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], lists], names=[*keys, "probabilities"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ready.select(*keys).schema)
    return ready.mapInArrow(run, f"{kept}, probabilities array<double>")


def context_windows(contexts: DataFrame, codes: DataFrame, stats: DataFrame) -> DataFrame:
    """Each distinct count and side as five equal steps with speed 93 and plate (0, 0), scaled; unknown sides are code 0."""
    sides = codes.where("kind = 'stand' AND value IS NOT NULL").select(F.col("value").alias("_side"), "code")
    rows = contexts.select("batter_stand", "balls", "strikes").distinct()
    rows = rows.join(F.broadcast(sides), F.col("batter_stand") == F.col("_side"), "left").crossJoin(F.broadcast(stats))  # a row per side, one row
    raw = {"release_speed": F.lit(93.0), "plate_x": F.lit(0.0), "plate_z": F.lit(0.0), "balls": F.col("balls"), "strikes": F.col("strikes"), "stand_code": F.coalesce("code", F.lit(0))}
    value = {c: (v - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c, v in raw.items()}
    return rows.select("batter_stand", "balls", "strikes", *[value[c].alias(f"{c}_{k}") for k in range(1, SEQUENCE + 1) for c in FEATURES])


def long_probabilities(scored: DataFrame, codes: DataFrame, *keys: str) -> DataFrame:
    """One row per code with its pitch type."""
    types = codes.where("kind = 'pitch_type'").select("code", F.col("value").alias("pitch_type"))
    each = scored.select(*keys, F.posexplode("probabilities").alias("code", "probability"))
    return each.join(F.broadcast(types), "code")  # a row per class


def top_predictions(rows: DataFrame, keys: tuple[str, ...] = CONTEXT_KEYS, k: int = TOP_K, least: float = MIN_PROBABILITY) -> DataFrame:
    """rank, pitch_type, percent of the k likeliest codes over ``least``; ties go to the lower code."""
    order = Window.partitionBy(*keys).orderBy(F.desc("probability"), "code")  # a row per class
    best = rows.where(F.col("probability") > least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(*keys, "rank", "pitch_type", F.expr(rounded("probability * 100e0", 1)).alias("percent"))


def in_arsenal(predictions: DataFrame, types: DataFrame) -> DataFrame:
    """Predictions of types that the pitcher throws, never EP or PO."""
    return predictions.where(~F.col("pitch_type").isin("EP", "PO")).join(types.select("pitcher", "pitch_type"), ["pitcher", "pitch_type"], "left_semi")


def with_fallback(contexts: DataFrame, predictions: DataFrame, types: DataFrame, keys: tuple[str, ...] = CONTEXT_KEYS) -> DataFrame:
    """Contexts left without a prediction get the pitcher's first type at 99.9, if the arsenal has any."""
    kept = in_arsenal(predictions, types).select(*keys, "rank", "pitch_type", "percent")
    first = types.groupBy("pitcher").agg(F.min("pitch_type").alias("pitch_type"))
    bare = contexts.select(*keys).distinct().join(kept.select(*keys).distinct(), list(keys), "left_anti").join(first, "pitcher")
    return kept.unionByName(bare.select(*keys, F.lit(1).alias("rank"), "pitch_type", F.lit(99.9).alias("percent")))


def predict_contexts(contexts: DataFrame, weights: dict[str, np.ndarray], codes: DataFrame, stats: DataFrame, types: DataFrame, k: int = TOP_K) -> DataFrame:
    """The whole chain in context mode: score distinct inputs, join back, top-k, arsenal, fallback."""
    inner = ("batter_stand", "balls", "strikes")
    scored = lstm_score(context_windows(contexts, codes, stats), weights, *inner)
    best = materialise(top_predictions(long_probabilities(scored, codes, *inner), inner, k), "predictions")  # k rows per count and side
    return with_fallback(contexts, contexts.select(*CONTEXT_KEYS).join(best, list(inner)), types)


def rule_based(contexts: DataFrame) -> DataFrame:
    """Without a model: FF 50.0 and SL 30.0 for every context."""
    rules = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(t).alias("pitch_type"), F.lit(p).alias("percent")) for r, t, p in ((1, "FF", 50.0), (2, "SL", 30.0))])
    return contexts.select(*CONTEXT_KEYS, F.explode(rules).alias("r")).select(*CONTEXT_KEYS, "r.rank", "r.pitch_type", "r.percent")
