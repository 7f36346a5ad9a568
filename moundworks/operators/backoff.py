"""Shares of pitch types by context, each level shrunk towards the one above: league, pitcher, pitcher with side and count.

A level's share of a type is (n of the type + w * the share above) / (n + w), a Dirichlet prior of weight w; the league's own
prior is uniform.  A pitcher or count that was never seen has n = 0 and so the share above, and a rare pitcher keeps what
is known of it: nobody is classed as "other".

The shares serve as features of a model, so a training row must not see its own label.  Rows are dealt to folds by game and
a fold's shares are made from the others': a level's counts over all folds less those of the fold.  One aggregation reads the
rows; each further level is summed from the one below, and rows meet only the finished shares of their context.

Nulls: rows without a type (or of one not asked for) are left out; a null pitcher, side or count is a value of its own; without
a game the fold is 0.  Without rows, all shares are uniform.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundworks.operators.models import context_rows

CELL = ("pitcher", "stand", "balls", "strikes")
FOLDS = 5
#: Weights of the priors of league, pitcher and cell, in pitches.
WEIGHTS = (1.0, 50.0, 20.0)
#: Weights to choose from.
GRID = (5.0, 20.0, 100.0, 500.0, 2_500.0, 12_500.0)
LEVELS = ("league", "pitcher", "cell")
LEAST = 1e-12


def pitch_classes(rows: DataFrame) -> list[str]:
    """The types in the rows, sorted: a few dozen."""
    return sorted(r[0] for r in rows.where("pitch_type IS NOT NULL").select("pitch_type").distinct().collect())


def fold(folds: int = FOLDS) -> Column:
    """The fold of a row: that of its game."""
    return F.coalesce(F.pmod("game_pk", F.lit(folds)), F.lit(0)).cast("int")


def class_counts(rows: DataFrame, classes: list[str], folds: int = FOLDS) -> DataFrame:
    """CELL, fold, total and n_0, n_1, ...: rows of each class.

    rows: pitches, or cases that stand for n pitches each.  Every level reads the counts, so write them first; counts of other
    rows may be added to them.
    """
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    each = [F.sum(F.when(F.col("pitch_type") == c, n).otherwise(0)).alias(f"n_{k}") for k, c in enumerate(classes)]
    return rows.where(F.col("pitch_type").isin(classes)).groupBy(*CELL, fold(folds).alias("fold")).agg(F.sum(n).alias("total"), *each)


def matched(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A left join by keys that may be null."""
    renamed = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    alike = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(renamed, reduce(Column.__and__, alike), "left").drop(*[f"_of_{k}" for k in keys])


def _level(counts: DataFrame, keys: tuple[str, ...], size: int, name: str, folded: bool) -> DataFrame:
    """Counts by keys as <name>_0, ...: over all folds or, if folded, by fold over all the others."""
    held = (*keys, "fold") if folded else keys
    sums = counts.groupBy(*held).agg(*[F.sum(f"n_{k}").alias(f"{name}_{k}") for k in range(size)])
    if not folded:
        return sums
    over = Window.partitionBy(*keys)  # a row per fold
    return sums.select(*held, *[(F.sum(f"{name}_{k}").over(over) - F.col(f"{name}_{k}")).alias(f"{name}_{k}") for k in range(size)])


def _with_counts(asked: DataFrame, counts: DataFrame, size: int, folded: bool) -> DataFrame:
    """asked, whose columns are CELL (and fold) at least, with each level's counts by class."""
    own = ("fold",) if folded else ()
    league = F.broadcast(_level(counts, (), size, "league", folded))  # a row per fold, or one row
    asked = matched(asked, league, own) if folded else asked.crossJoin(league)
    asked = matched(asked, _level(counts, CELL[:1], size, "pitcher", folded), (*CELL[:1], *own))
    asked = matched(asked, _level(counts, CELL, size, "cell", folded), (*CELL, *own))
    return asked.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("double") for level in LEVELS for c in _names(level, size)})


def _names(level: str, size: int) -> list[str]:
    return [f"{level}_{k}" for k in range(size)]


def _total(level: str, size: int) -> Column:
    return reduce(Column.__add__, map(F.col, _names(level, size)))


def _with_shares(asked: DataFrame, counts: DataFrame, size: int, weights: tuple[float, float, float], folded: bool) -> DataFrame:
    """asked with p_0, p_1, ..."""
    if min(weights) <= 0:
        raise ValueError("a prior needs a weight above 0")
    asked, made = _with_counts(asked, counts, size, folded), []
    share: list[Column] = [F.lit(1.0 / size)] * size
    for level, weight in zip(LEVELS, weights):
        total = _total(level, size)
        asked = asked.withColumns({f"{level}_share_{k}": (F.col(c) + weight * share[k]) / (total + weight) for k, c in enumerate(_names(level, size))})
        share = [F.col(f"{level}_share_{k}") for k in range(size)]
        made += [*_names(level, size), *_names(f"{level}_share", size)]
    return asked.withColumns({f"p_{k}": share[k] for k in range(size)}).drop(*made)


def fit_weights(counts: DataFrame, classes: list[str], grid: tuple[float, ...] = GRID) -> tuple[float, float, float]:
    """The weights of pitcher and cell, from the grid, under which folds are likeliest given the others; the league's is WEIGHTS'.

    One pass over the folds' observed classes sums the log-likelihood of every pair.  Equal ones go to the heavier prior,
    and without rows the heaviest is taken.
    """
    size, heavy = len(classes), max(grid)
    pairs = sorted(((p, c) for p in grid for c in grid), reverse=True)
    if not size:
        return (WEIGHTS[0], heavy, heavy)
    seen = F.array(*[F.struct(F.col(f"n_{k}").alias("n"), *[F.col(f"{level}_{k}").alias(level) for level in LEVELS]) for k in range(size)])
    each = _with_counts(counts, counts, size, True).select(*[_total(level, size).alias(f"{level}_all") for level in LEVELS], F.explode(seen).alias("of")).where("of.n > 0")
    league = (F.col("of.league") + WEIGHTS[0] / size) / (F.col("league_all") + WEIGHTS[0])
    pitcher = lambda p: (F.col("of.pitcher") + p * league) / (F.col("pitcher_all") + p)
    likely = [F.sum(F.col("of.n") * F.log((F.col("of.cell") + c * pitcher(p)) / (F.col("cell_all") + c))) for p, c in pairs]
    sums = each.agg(F.array(*likely).alias("likely")).first()["likely"]
    best = max(range(len(pairs)), key=lambda k: (sums[k] if sums[k] is not None else 0.0, -k))
    return (WEIGHTS[0], *pairs[best])


def out_of_fold(counts: DataFrame, classes: list[str], weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """CELL, fold, n (array by class: the fold's own rows) and shares (array by class, from the other folds)."""
    size = len(classes)
    if not size:
        return counts.select(*CELL, "fold", F.array().cast("array<bigint>").alias("n"), F.array().cast("array<double>").alias("shares"))
    made = _with_shares(counts, counts, size, weights, True)
    return made.select(*CELL, "fold", F.array(*[f"n_{k}" for k in range(size)]).alias("n"), F.array(*[f"p_{k}" for k in range(size)]).alias("shares"))


def with_shares(contexts: DataFrame, counts: DataFrame, classes: list[str], weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """contexts with shares (array by class) from all folds, for rows that are not in the counts.

    Shares are made once per distinct context, which may have columns of any names.
    """
    if not classes:
        return contexts.withColumn("shares", F.array().cast("array<double>"))
    size = len(classes)
    asked = _with_shares(contexts.select(*CELL).distinct(), counts, size, weights, False)
    return matched(contexts.drop("shares"), asked.select(*CELL, F.array(*[f"p_{k}" for k in range(size)]).alias("shares")), CELL)


def with_out_of_fold(rows: DataFrame, counts: DataFrame, classes: list[str], weights: tuple[float, float, float] = WEIGHTS, folds: int = FOLDS) -> DataFrame:
    """rows that the counts were made from, with the shares of their context in the other folds."""
    shares = out_of_fold(counts, classes, weights).select(*CELL, F.col("fold").alias("_fold"), "shares")
    return matched(rows.drop("shares").withColumn("_fold", fold(folds)), shares, (*CELL, "_fold")).drop("_fold")


def observed(shares: DataFrame, classes: list[str]) -> DataFrame:
    """CELL, fold, pitch_type, n, probability: what a fold holds, and how likely the other folds make it."""
    each = shares.select(*CELL, "fold", F.posexplode("n").alias("code", "n"), "shares").where("n > 0")
    return each.select(*CELL, "fold", F.get(F.lit(classes).cast("array<string>"), F.col("code")).alias("pitch_type"), "n", F.get("shares", F.col("code")).alias("probability"))


def train_forest(rows: DataFrame, classes: list[str], trees: int = 20, depth: int = 8, seed: int = 7) -> PipelineModel:
    """Random forest over shares (``with_out_of_fold``), side, count, outs and inning; label k is classes[k].  Rows may
    be cases with a weight n."""
    label = F.array_position(F.lit(classes), F.col("pitch_type")) - 1
    rows = rows if "n" in rows.columns else rows.withColumn("n", F.lit(1))
    ready = forest_rows(rows.where(F.col("pitch_type").isin(classes))).withColumn("label", label.cast("double"))
    stages = [StringIndexer(inputCol="stand", outputCol="stand_index", handleInvalid="keep")]
    stages.append(VectorAssembler(inputCols=["share_vector", "stand_index", "balls", "strikes", "outs_when_up", "inning"], outputCol="features"))
    stages.append(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="n"))
    return Pipeline(stages=stages).fit(ready)


def forest_rows(rows: DataFrame) -> DataFrame:
    return context_rows(rows).withColumn("share_vector", array_to_vector("shares"))


def forest_probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows that have shares, with probabilities (array by label); rows without a count, outs or inning are left out."""
    made = model.transform(forest_rows(rows)).withColumn("probabilities", vector_to_array("probability"))
    return made.drop("share_vector", "stand_index", "features", "rawPrediction", "probability", "prediction")


def log_loss(classes: list[str], probabilities: str) -> Column:
    """The negative log-likelihood of a row's pitch type; a type that is no class has probability LEAST."""
    likely = F.get(F.col(probabilities), (F.array_position(F.lit(classes), F.col("pitch_type")) - 1).cast("int"))
    return -F.log(F.greatest(F.coalesce(likely, F.lit(LEAST)), F.lit(LEAST)))
