"""Trained models saved with all that is needed to use them, in versions.

A bundle has a kind ('recurrent' or 'perceptron'), the model's numbers, and its encoders: pitch types and batter sides in
the order of their codes, the scaler's means and deviations, the features, input_size and num_classes.  A version is written
to a folder of its own and then published by one row of a small table of versions: a reader sees the version before or
the new one, whole.  The table's highest number is the one in use; of two published at once the greater folder name is.

A bundle is checked when it is made, when it is published and when it is loaded: sizes must agree with classes and features,
and a digest covers numbers and encoders, so parts of different trainings are refused.  Everything is a Parquet table or a
Spark ML model, so it works wherever Spark can write.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.functions.constants import FEATURES, SEQUENCE

VERSIONS = "number long, folder string, digest string"


class Mismatch(ValueError):
    """Parts that do not belong together."""


@dataclass(frozen=True)
class Encoders:
    """What turns pitches into a model's input and its output into pitch types."""

    classes: tuple[str, ...]
    sides: tuple[str | None, ...]
    means: tuple[float | None, ...]
    deviations: tuple[float | None, ...]
    features: tuple[str, ...] = FEATURES
    sequence: int = SEQUENCE

    @property
    def input_size(self) -> int:
        return len(self.features)

    @property
    def num_classes(self) -> int:
        return len(self.classes)

    @staticmethod
    def of(codes: DataFrame, stats: DataFrame) -> Encoders:
        """From label codes (a row per class) and scaler statistics (one row)."""
        values: dict[str, list] = {"pitch_type": [], "stand": []}
        for r in codes.orderBy("kind", "code").collect():
            values[r["kind"]].append(r["value"])
        row = stats.first()
        of = lambda s: tuple(row[f"{c}_{s}"] for c in FEATURES)
        return Encoders(tuple(values["pitch_type"]), tuple(values["stand"]), of("mean"), of("std"))

    def codes(self, spark: SparkSession) -> DataFrame:
        """kind, value, code."""
        rows = [(kind, v, k) for kind, values in (("pitch_type", self.classes), ("stand", self.sides)) for k, v in enumerate(values)]
        return spark.createDataFrame(rows, "kind string, value string, code int")

    def stats(self, spark: SparkSession) -> DataFrame:
        """One row: <feature>_mean and <feature>_std."""
        values = {f"{c}_{s}": v for c, m, d in zip(self.features, self.means, self.deviations, strict=True) for s, v in (("mean", m), ("std", d))}
        return spark.createDataFrame([tuple(values.values())], ", ".join(f"{c} double" for c in values))


@dataclass(frozen=True)
class Bundle:
    kind: str
    encoders: Encoders
    model: dict[str, np.ndarray] | PipelineModel

    def __post_init__(self) -> None:
        e = self.encoders
        if not len(e.features) == len(e.means) == len(e.deviations):
            raise Mismatch("the scaler does not cover the features")
        if self.kind == "recurrent":
            sizes = {"num_classes": (self.model["fc_weight"].shape[0], e.num_classes), "input_size": (self.model["weight_ih_l0"].shape[1], e.input_size)}
        elif self.kind == "perceptron":
            layers = self.model.stages[-1].getLayers()
            sizes = {"num_classes": (layers[-1], e.num_classes), "input_size": (layers[0], e.input_size * e.sequence)}
        else:
            raise Mismatch(f"no such kind of model: {self.kind}")
        for name, (has, wants) in sizes.items():
            if has != wants:
                raise Mismatch(f"the model's {name} is {has}, the encoders' {wants}")

    @property
    def digest(self) -> str:
        held = hashlib.sha256(json.dumps([self.kind, asdict(self.encoders)]).encode())
        for name, value in sorted((self.model if self.kind == "recurrent" else {"weights": np.array(self.model.stages[-1].weights.toArray())}).items()):
            held.update(f"|{name}{value.shape}{value.dtype}".encode() + np.ascontiguousarray(value).tobytes())
        return held.hexdigest()


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The published versions of a bundle; no rows if there is none."""
    try:
        return spark.read.schema(VERSIONS).parquet(f"{root}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSIONS)


def current(spark: SparkSession, root: str) -> tuple[int, str, str] | None:
    """number, folder, digest of the version in use."""
    found = versions(spark, root).orderBy(F.desc("number"), F.desc("folder")).first()
    return tuple(found) if found else None


def publish(spark: SparkSession, root: str, bundle: Bundle) -> int:
    """Write a bundle as a new version and put it in use; returns its number."""
    folder = f"version-{uuid.uuid4().hex}"
    path = f"{root}/{folder}"
    if bundle.kind == "recurrent":
        rows = [(k, [int(n) for n in v.shape], v.dtype.str, bytearray(np.ascontiguousarray(v).tobytes())) for k, v in bundle.model.items()]
        spark.createDataFrame(rows, "name string, shape array<int>, kind string, data binary").coalesce(1).write.parquet(f"{path}/weights")
    else:
        bundle.model.save(f"{path}/model")
    e = bundle.encoders
    about = json.dumps(asdict(e) | {"input_size": e.input_size, "num_classes": e.num_classes})
    spark.createDataFrame([(bundle.kind, about, bundle.digest)], "kind string, encoders string, digest string").coalesce(1).write.parquet(f"{path}/about")
    number = (current(spark, root) or (0,))[0] + 1
    spark.createDataFrame([(number, folder, bundle.digest)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return number


def load(spark: SparkSession, root: str, classes: tuple[str, ...] | None = None) -> Bundle:
    """The bundle in use.  classes: the pitch types, in order, that the caller means by the codes; another list is refused."""
    found = current(spark, root)
    if found is None:
        raise FileNotFoundError(f"no bundle has been published at {root}")
    path = f"{root}/{found[1]}"
    kind, about, digest = spark.read.parquet(f"{path}/about").first()
    about = json.loads(about)
    encoders = Encoders(*(tuple(about[c]) for c in ("classes", "sides", "means", "deviations", "features")), about["sequence"])
    if kind == "recurrent":
        model = {r["name"]: np.frombuffer(bytes(r["data"]), r["kind"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/weights").collect()}  # one network
    else:
        model = PipelineModel.load(f"{path}/model")
    bundle = Bundle(kind, encoders, model)
    if not bundle.digest == digest == found[2] or (about["input_size"], about["num_classes"]) != (encoders.input_size, encoders.num_classes):
        raise Mismatch(f"{path}: numbers and encoders are not of one training")
    if classes is not None and tuple(classes) != encoders.classes:
        raise Mismatch(f"the bundle's classes are {encoders.classes}, not {tuple(classes)}")
    return bundle
