"""Back-off shares against plain arithmetic, and what they are good for."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from moundworks.operators import backoff, models

ROW = "game_pk long, pitcher long, stand string, balls int, strikes int, outs_when_up int, inning int, pitch_type string"


def some_rows(n, seed=3):
    r = random.Random(seed)
    pick = lambda *values: r.choice(values)
    return [(pick(None, *range(12)), pick(1, 1, 1, 2, 3, None), pick("L", "R", None), pick(0, 1, None), pick(0, 1), pick(0, 1), 1, pick("FF", "FF", "SL", "CU", None)) for _ in range(n)]


def plain_shares(rows, classes, cell, weights=backoff.WEIGHTS):
    share = [1 / len(classes)] * len(classes)
    for depth, weight in zip((0, 1, 4), weights):
        of = Counter(r[7] for r in rows if r[7] is not None and r[1:5][:depth] == cell[:depth])
        total = sum(of.values())
        share = [(of[c] + weight * share[k]) / (total + weight) for k, c in enumerate(classes)]
    return share


def fold_of(r, folds=backoff.FOLDS):
    return 0 if r[0] is None else r[0] % folds


def test_out_of_fold_shares_are_those_of_the_other_games(spark):
    rows = some_rows(400)
    df = spark.createDataFrame(rows, ROW)
    classes = backoff.pitch_classes(df)
    got = backoff.out_of_fold(backoff.class_counts(df, classes), classes).collect()
    assert classes == ["CU", "FF", "SL"]
    assert len(got) == len({(*r[1:5], fold_of(r)) for r in rows if r[7] is not None})
    for g in got:
        cell, others = tuple(g[c] for c in backoff.CELL), [r for r in rows if fold_of(r) != g["fold"]]
        own = Counter(r[7] for r in rows if fold_of(r) == g["fold"] and r[1:5] == cell and r[7])
        assert g["n"] == [own[c] for c in classes]
        assert g["shares"] == pytest.approx(plain_shares(others, classes, cell), abs=1e-12) and math.isclose(sum(g["shares"]), 1)
    assert sum(r["n"] for r in backoff.observed(backoff.out_of_fold(backoff.class_counts(df, classes), classes), classes).collect()) == sum(r[7] is not None for r in rows)


def test_a_row_does_not_see_its_own_label(spark):
    """The one pitch of a type lies in fold 1: there its probability is as if it had never been thrown."""
    rows = [(0, 1, "L", 0, 0, 0, 1, "FF")] * 30 + [(1, 1, "L", 0, 0, 0, 1, "KN")]
    df = spark.createDataFrame(rows, ROW)
    counts = backoff.class_counts(df, ["FF", "KN"])
    with_it = backoff.with_out_of_fold(df, counts, ["FF", "KN"]).where("pitch_type = 'KN'").first()["shares"]
    without = backoff.with_shares(df.limit(1), backoff.class_counts(df.where("pitch_type = 'FF'"), ["FF", "KN"]), ["FF", "KN"]).first()["shares"]
    assert with_it == pytest.approx(without, abs=1e-15)


def test_unseen_contexts_back_off(spark):
    rows = some_rows(300)
    df = spark.createDataFrame(rows, ROW)
    classes = backoff.pitch_classes(df)
    asked = spark.createDataFrame([(99, "L", 0, 0, "a", "b"), (2, "S", 0, 0, "a", "b"), (2, "L", 1, 1, "a", "b"), (None, None, None, 0, "a", "b")], "pitcher long, stand string, balls int, strikes int, n_0 string, shares string")
    got = backoff.with_shares(asked.union(asked), backoff.class_counts(df, classes), classes).collect()
    assert len(got) == 8 and {g["n_0"] for g in got} == {"a"}
    for g in got:
        assert g["shares"] == pytest.approx(plain_shares(rows, classes, tuple(g[c] for c in backoff.CELL)), abs=1e-12)


def test_no_rows(spark):
    none = spark.createDataFrame([], ROW)
    assert backoff.pitch_classes(none) == [] and backoff.observed(backoff.out_of_fold(backoff.class_counts(none, []), []), []).count() == 0
    asked = spark.createDataFrame([(1, "L", 0, 0)], "pitcher long, stand string, balls int, strikes int")
    assert backoff.with_shares(asked, backoff.class_counts(none, ["FF", "SL"]), ["FF", "SL"]).first()["shares"] == [0.5, 0.5]
    assert backoff.with_shares(asked, backoff.class_counts(none, []), []).first()["shares"] == []
    with pytest.raises(ValueError, match="above 0"):
        backoff.with_shares(asked, backoff.class_counts(none, ["FF"]), ["FF"], (1.0, 0.0, 1.0))


def test_counts_are_added(spark):
    """A season's counts are added to those before it; no row is read again."""
    df = spark.createDataFrame(some_rows(300), ROW)
    classes = ["CU", "FF", "SL"]
    whole = backoff.out_of_fold(backoff.class_counts(df, classes), classes)
    parts = backoff.class_counts(df.where("game_pk < 5"), classes).unionByName(backoff.class_counts(df.where("game_pk >= 5 OR game_pk IS NULL"), classes))
    added = parts.groupBy(*backoff.CELL, "fold").agg(F.sum("total").alias("total"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in range(3)])
    assert sorted(map(str, backoff.out_of_fold(added, classes).collect())) == sorted(map(str, whole.collect()))


def test_weights_are_those_of_the_highest_likelihood(spark):
    rows = some_rows(300)
    df = spark.createDataFrame(rows, ROW)
    classes, grid = backoff.pitch_classes(df), (2.0, 30.0, 900.0)

    def likelihood(weights):
        found = 0.0
        for f in range(backoff.FOLDS):
            others = [r for r in rows if fold_of(r) != f]
            shares = {cell: plain_shares(others, classes, cell, weights) for cell in {r[1:5] for r in rows}}
            found += sum(math.log(shares[r[1:5]][classes.index(r[7])]) for r in rows if fold_of(r) == f and r[7])
        return found

    want = max(((backoff.WEIGHTS[0], p, c) for p in grid for c in grid), key=likelihood)
    assert backoff.fit_weights(backoff.class_counts(df, classes), classes, grid) == want
    assert backoff.fit_weights(backoff.class_counts(df.limit(0), classes), classes, grid) == (backoff.WEIGHTS[0], 900.0, 900.0)


def test_a_pitcher_outside_the_frequent_ones_is_known_by_what_they_throw(spark):
    """63 pitchers with 600 pitches and 6 with 500, who each throw two types of their own nine times in ten."""
    types = ["CH", "CU", "FC", "FF", "SI", "SL"]
    each = spark.range(63).select(F.col("id").alias("pitcher"), F.lit(600).alias("n")).union(spark.range(63, 69).select("id", F.lit(500)))
    df = each.select("pitcher", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).withColumn("u", F.pmod(F.xxhash64("pitcher", "k"), F.lit(1000)))
    own = F.when(F.col("u") < 600, F.col("pitcher") % 6).when(F.col("u") < 900, (F.col("pitcher") + 1) % 6).otherwise(F.col("u") % 6)
    df = df.select(F.expr("pitcher * 100 + k div 100").alias("game_pk"), F.get(F.lit(types), own.cast("int")).alias("pitch_type"), "pitcher", F.when(F.col("k") % 2 == 0, "L").otherwise("R").alias("stand"),
                   (F.col("k") % 4).cast("int").alias("balls"), (F.col("k") % 3).cast("int").alias("strikes"), (F.col("k") % 3).cast("int").alias("outs_when_up"), (F.col("k") % 9).cast("int").alias("inning"), "k").cache()
    learned, judged = df.where("k % 10 <> 7"), df.where("k % 10 = 7 AND pitcher >= 63")
    counts = backoff.class_counts(learned, types)
    forest = backoff.train_forest(backoff.with_out_of_fold(learned, counts, types), types, trees=10)
    classes = models.train_context_model(learned, trees=10)
    assert not {str(k) for k in range(63, 69)} & set(models.frequent_pitchers(classes))
    scored = models.class_probabilities(classes, backoff.forest_probabilities(forest, backoff.with_shares(judged, counts, types)).withColumnRenamed("probabilities", "by_forest"))
    r = scored.agg(F.count("*").alias("n"), *[F.avg(backoff.log_loss(types, c)).alias(c) for c in ("probabilities", "by_forest", "shares")]).first()
    assert r["n"] == 300 and r["by_forest"] < r["probabilities"] - 0.3 and r["shares"] < r["probabilities"] - 0.3
