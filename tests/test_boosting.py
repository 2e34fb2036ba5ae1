"""Boosted trees over bins: those of Spark where nothing is drawn, each fitted once, up to the round that patience names."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor

from tideline.operators import boosting, scoring

COLUMNS = ["a", "b", "c"]


def rows_of(spark, folds=("f1", "f2"), n=3000):
    rng, rows = random.Random(6), []
    for fold in folds:
        for k in range(n):
            a, b, c = rng.randrange(60) / 7, rng.randrange(200) / 3, rng.gauss(0, 1).__round__(1)
            y = np.sin(a) + (b > 30) * c + rng.gauss(0, 0.5)
            rows.append((fold, ["train", "train", "valid", "test"][k % 4], date(2020, 1, 6), f"i{k}", float(y), a, b, c))
    return spark.createDataFrame(rows, "fold_id string, segment string, datetime date, instrument string, label double, a double, b double, c double").repartition(5).cache()


def scores(df):
    return {(r.fold_id, r.instrument): r.score for r in df.collect()}


def test_trees_are_those_of_spark(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 200)
    rows = rows_of(spark)
    how = boosting.Settings(rounds=11, patience=50, step=0.3, least=20, rows=1.0, columns=1.0)
    models = boosting.fit(rows, COLUMNS, how)
    got = scores(boosting.scored(rows.where("segment = 'test'"), models, COLUMNS))
    assert len(got) == 1500
    vectors = VectorAssembler(inputCols=COLUMNS, outputCol="x").transform(rows)
    for fold in ("f1", "f2"):
        own = vectors.where(f"fold_id = '{fold}'")
        plain = GBTRegressor(featuresCol="x", labelCol="label", predictionCol="score", maxDepth=5, maxBins=255, minInstancesPerNode=20, stepSize=0.3, maxIter=models[fold].getNumTrees)
        assert plain.getMaxIter() > 3
        want = scores(plain.fit(own.where("segment = 'train'")).transform(own.where("segment = 'test'")))
        assert {k: got[k] for k in want} == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_every_round_is_fitted_once(spark, monkeypatch):
    """One pass a level: the round that ends a fold is not followed by another fit from nothing."""
    rows, passes = rows_of(spark, ("f1",)), []
    whole = boosting.Growing
    monkeypatch.setattr(boosting, "Growing", lambda *a: passes.append(a[:2]) or whole(*a))
    how = boosting.Settings(rounds=200, patience=3, step=1.0, least=5)
    model = boosting.fit(rows, COLUMNS, how)["f1"]
    ended = max(turn for turn, _ in passes)
    assert ended == model.getNumTrees + how.patience < how.rounds
    assert len(passes) == len(set(passes)) <= how.depth * ended + 1


def test_same_scores_by_other_partitions_and_folds_side_by_side(spark):
    rows, how = rows_of(spark), boosting.Settings(rounds=7, rows=1.0)
    both = boosting.fit(rows, COLUMNS, how)
    alone = boosting.fit(rows.where("fold_id = 'f2'").repartition(2), COLUMNS, how)
    test = rows.where("fold_id = 'f2' and segment = 'test'")
    assert scores(boosting.scored(test, both, COLUMNS)) == pytest.approx(scores(boosting.scored(test, alone, COLUMNS)), rel=1e-9)


def test_folds_without_a_part_have_no_model(spark):
    rows = rows_of(spark).where("fold_id = 'f1' or segment <> 'valid'")
    models = boosting.fit(rows, COLUMNS, boosting.Settings(rounds=2))
    assert set(models) == {"f1"} and {f for f, _ in scores(boosting.scored(rows, models, COLUMNS))} == {"f1"}
    out = scoring.walk_forward(rows, ["none"], COLUMNS)
    assert out.collect() == [] and out.columns == ["datetime", "instrument", "score", "fold_id", "model_id"]


def test_thresholds_keep_even_shares():
    assert boosting.midpoints(np.array([1.0, 2, 2, 4]), 255).tolist() == [1.5, 3.0]
    assert boosting.midpoints(np.array([3.0, 3.0]), 255).tolist() == []
    many = boosting.midpoints(np.arange(10_000.0), 255)
    assert len(many) == 254 and np.diff(many).max() <= 41
