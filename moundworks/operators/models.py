"""Batch training of next-pitch models with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.functions.constants import FEATURES, SEQUENCE
from moundworks.sources.shared import materialise

INPUTS = [f"{c}_{k}" for k in range(1, SEQUENCE + 1) for c in FEATURES]
CONTEXT = ("pitcher", "stand", "balls", "strikes", "outs_when_up", "inning")
OTHER = "other"


def train_sequence_model(dataset: DataFrame, hidden: int = 32, iterations: int = 20, seed: int = 7, classes: int | None = None) -> PipelineModel:
    """Next code from a flattened 5 x 6 window by softmax and cross-entropy; incomplete windows are left out.

    classes: the number of codes, else that of the highest label seen.
    """
    rows = dataset.na.drop(subset=INPUTS).withColumn("label", F.col("label").cast("double"))
    classes = classes or int(rows.agg(F.max("label")).first()[0] or 0) + 1
    net = MultilayerPerceptronClassifier(layers=[len(INPUTS), hidden, classes], maxIter=iterations, seed=seed, blockSize=1024)
    return Pipeline(stages=[VectorAssembler(inputCols=INPUTS, outputCol="features"), net]).fit(rows)


def held_out(rows: DataFrame, folds: int = 10) -> tuple[DataFrame, DataFrame]:
    """Windows to learn from, and one in ``folds`` to judge by."""
    fold = F.pmod(F.xxhash64("idx"), F.lit(folds))
    return rows.where(fold != 0), rows.where(fold == 0)


def log_losses(model: PipelineModel, learned: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: the mean negative log-likelihood of held-out labels under the model, and under the labels' shares alone."""
    least = F.lit(1e-12)
    complete = judged.na.drop(subset=INPUTS)
    likely = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    modelled = model.transform(complete).agg(F.avg(-F.log(F.greatest(F.coalesce(likely, least), least))).alias("held_out_loss"))
    return modelled.crossJoin(prior_loss(learned, complete))


def prior_loss(learned: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: the mean negative log-likelihood of labels under the shares of those learned from."""
    least = F.lit(1e-12)
    shares = learned.groupBy("label").agg(F.count("*").alias("n"))  # a row per class
    total = shares.agg(F.sum("n").alias("total"))
    return judged.join(F.broadcast(shares), "label", "left").crossJoin(F.broadcast(total)).agg(F.avg(-F.log(F.greatest(F.coalesce(F.col("n") / F.col("total"), least), least))).alias("prior_loss"))


def loss_history(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """iteration, loss of a trained sequence model."""
    history = model.stages[-1].summary().objectiveHistory
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(history)], "iteration int, loss double")


def cases(rows: DataFrame, *more: str) -> DataFrame:
    """n: how often each context comes with each pitch type (and with more columns); there are far fewer than pitches."""
    return rows.groupBy(*CONTEXT, "pitch_type", *more).agg(F.count("*").alias("n"))


def train_context_model(rows: DataFrame, trees: int = 20, pitchers: int = 64, seed: int = 7) -> PipelineModel:
    """Random forest on the game context; the most frequent pitchers have a category each, the rest share one.

    rows: pitches, or their ``cases`` with a weight n; a tree's bootstrap draws cases.
    """
    rows = rows if "n" in rows.columns else materialise(cases(rows), "cases")
    top = rows.groupBy("pitcher").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "pitcher").limit(pitchers - 1).select("pitcher")
    frequent = [str(r[0]) for r in top.collect() if r[0] is not None]  # fewer than the forest's bins
    ready = context_rows(rows.withColumn("pitcher_class", pitcher_class(frequent)))
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in ("pitcher_class", "stand")]
    stages.append(StringIndexer(inputCol="pitch_type", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"))
    stages.append(VectorAssembler(inputCols=["pitcher_class_index", "stand_index", "balls", "strikes", "outs_when_up", "inning"], outputCol="features"))
    stages.append(RandomForestClassifier(numTrees=trees, maxDepth=6, maxBins=pitchers + 1, seed=seed, weightCol="n"))
    return Pipeline(stages=stages).fit(ready)


def pitcher_class(frequent: list[str]) -> Column:
    """A frequent pitcher's own category, or the one that all others share, null among them."""
    name = F.col("pitcher").cast("string")
    return F.when(name.isin(frequent), name).otherwise(OTHER)


def frequent_pitchers(model: PipelineModel) -> list[str]:
    """The pitchers with a category each, as the (saved) model carries them."""
    return [x for x in model.stages[0].labelsArray[0] if x != OTHER]


def context_rows(rows: DataFrame) -> DataFrame:
    return rows.na.fill("unknown", subset=["stand"]).na.drop(subset=["balls", "strikes", "outs_when_up", "inning"])


def class_probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with probabilities; pitchers are classed as they were when the model was fit."""
    rows = rows.withColumn("pitcher_class", pitcher_class(frequent_pitchers(model)))
    return model.transform(rows).withColumn("probabilities", vector_to_array("probability"))


def predictions(model: PipelineModel, dataset: DataFrame) -> DataFrame:
    """idx, label and the predicted code of every complete window."""
    return model.transform(dataset.na.drop(subset=INPUTS)).select("idx", "label", F.col("prediction").cast("int").alias("predicted"))
