"""Boosted trees by histograms: Spark's own trainer's trees, from rows that stay small."""

import math
import threading
import time

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from credence.operators import boosting, models, preprocess


def _rows(spark, n=3000):
    k = F.col("id")
    u = lambda a: F.abs(F.hash(k, F.lit(a))) % 1000
    return spark.range(0, n, 1, 4).select(
        (u(1) + F.when(u(2) % 7 < 3, 300).otherwise(0) + u(3) % 20 * 20 > 900).cast("int").alias("default_flag"),
        (u(3) % 20).cast("double").alias("x"), F.when(u(4) % 9 != 0, (u(4) % 12).cast("double")).alias("gaps"), F.concat(F.lit("c"), (u(2) % 7).cast("string")).alias("c"),
        F.when(u(5) % 5 != 0, F.concat(F.lit("d"), (u(5) % 90).cast("string"))).alias("d"))


@pytest.mark.parametrize("more", [{}, {"scale_pos_weight": 3.0, "min_child_weight": 40, "gamma": 1e-4}])
def test_trees_are_those_of_spark(spark, monkeypatch, more):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)  # several blocks
    train = _rows(spark)
    config = {"n_estimators": 7, "max_depth": 3, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0, **more}
    model = models.train_boosted_trees(train, config=config)
    rows = preprocess.fit_preprocessor(train, exclude=("default_flag",)).transform(train)
    weighted = rows.withColumn("w", F.when(F.col("default_flag") == 1, more.get("scale_pos_weight", 1.0)).otherwise(1.0))
    own = GBTClassifier(labelCol="default_flag", weightCol="w", maxIter=7, maxDepth=3, stepSize=0.3, minInstancesPerNode=more.get("min_child_weight", 1), minInfoGain=more.get("gamma", 0.0)).fit(weighted)
    got, want = (m.transform(rows).select(vector_to_array("probability")[1]).collect() for m in (model.stages[-1], own))
    assert np.allclose(got, want, atol=1e-9) and len({r[0] for r in got}) > 20
    assert np.allclose(model.stages[-1].featureImportances.toArray(), own.featureImportances.toArray(), atol=1e-9)
    assert model.stages[-1].treeWeights == own.treeWeights and model.stages[-1].numFeatures == own.numFeatures


def test_rows_held_for_the_trees_are_small(spark):
    """What is held of a row does not grow with the categories: Spark's own trainer holds a number for each."""
    train = _rows(spark, 40_000).withColumn("e", F.concat(F.lit("e"), (F.abs(F.hash("x", "gaps", "d")) % 400).cast("string")))
    most, done = [0], threading.Event()

    def watch():
        while not done.is_set():
            most[0] = max(most[0], sum(i.memSize() + i.diskSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()))
            time.sleep(0.02)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        models.train_boosted_trees(train, config={"n_estimators": 6})
    finally:
        done.set()
        watcher.join()
    assert most[0] < 40_000 * 400


def test_cuts(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 3).select((F.col("id") % 5).cast("double").alias("few"), F.col("id").cast("double").alias("many"), F.lit(7.0).alias("one"),
                                             F.when(F.col("id") % 3 == 0, math.inf).when(F.col("id") % 3 == 1, math.nan).otherwise(1.0).alias("odd"))
    n, (few, many, one, odd) = boosting._cuts(rows, rows.columns, 8)
    assert n == 1000 and few.tolist() == [0.5, 1.5, 2.5, 3.5] and one.tolist() == [] and odd.tolist() == [1.0]
    assert len(many) == 7 and np.abs(many - np.arange(1, 8) * 125).max() < 3
    layout = boosting._Layout([few, many, one], [3, 5000, 2], 1.0)
    assert layout.bins == [5, 8, 1, 4, 5001, 3] and layout.groups == [range(0, 4), range(4, 5), range(5, 6)] and layout.kinds == [np.uint8, np.uint16, np.uint8]


def test_levels_in_several_passes(spark, monkeypatch):
    train = _rows(spark)
    fit = lambda: [r[0] for r in models.score(models.train_boosted_trees(train, config={"n_estimators": 6, "max_depth": 4}), train, keep=()).collect()]
    plain = fit()
    monkeypatch.setattr(boosting, "SUM_BYTES", 8 * 3 * 300)
    monkeypatch.setattr(boosting, "SENT_BYTES", 0)
    monkeypatch.setattr(boosting, "HELD_TREES", 2)
    monkeypatch.setattr(boosting, "FRESH_TREES", 4)
    assert np.allclose(fit(), plain, atol=1e-9)
    with pytest.raises(Exception, match="labels of 0 and 1"):
        models.train_boosted_trees(train.withColumn("default_flag", F.lit(2)), config={"n_estimators": 1})


def test_a_tree_of_one_leaf(spark):
    train = _rows(spark, 400)
    model = models.train_boosted_trees(train, config={"n_estimators": 2, "max_depth": 0, "subsample": 1.0})
    share = train.agg(F.avg("default_flag")).first()[0]
    found = {r[0] for r in models.score(model, train, keep=()).collect()}
    assert len(found) == 1 and (found.pop() > 0.5) == (share > 0.5)
