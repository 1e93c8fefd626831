"""Boosted trees against MLlib's own training, on rows of few and of many tasks."""

import numpy as np
import pytest
from pyspark.ml import classification as ml
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskloom.plans import boosting
from riskloom.plans.models import with_probability

PARAMS = {"featuresCol": "plain", "labelCol": "label", "weightCol": "weight", "seed": 42}


@pytest.fixture(scope="module")
def rows(spark):
    """3,000 rows: wide-ranging, few-valued, zero-heavy, two-valued and constant features; few positives, of a higher weight."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=3000), rng.exponential(size=3000), rng.integers(0, 5, 3000),
                         np.where(rng.random(3000) < 0.7, 0.0, rng.normal(size=3000)), rng.integers(0, 2, 3000), np.full(3000, 7.0)])
    label = (x[:, 0] + 0.5 * x[:, 2] - x[:, 3] + rng.normal(size=3000) > 3.2).astype(float)
    return spark.createDataFrame([(Vectors.dense(v), float(y), 9.5 if y else 1.0) for v, y in zip(x, label)], ["plain", "label", "weight"]).repartition(6).cache()


def _apart(rows, a, b) -> float:
    both = with_probability(with_probability(rows, a, "p"), b, "q")
    return both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]


@pytest.mark.parametrize("rows_per_task", [100_000, 400])
def test_trees_are_those_of_mllib(rows, monkeypatch, rows_per_task):
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", rows_per_task)
    monkeypatch.setattr(boosting, "CHAIN_TREES", 3)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 256)
    asked = {**PARAMS, "maxDepth": 4, "maxIter": 8, "stepSize": 0.3}
    own, theirs = boosting.GBTClassifier(**asked).fit(rows), ml.GBTClassifier(**asked).fit(rows)
    assert own.treeWeights == theirs.treeWeights and own.numFeatures == 6
    assert _apart(rows, own, theirs) < 1e-9
    assert [t.numNodes for t in own.trees] == [t.numNodes for t in theirs.trees]


def test_split_candidates_of_many_rows_are_mllibs(spark):
    """Over 10,000 rows they come from a sample, which has to be the same rows."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=14_000), rng.exponential(size=14_000), np.where(rng.random(14_000) < 0.6, 0.0, rng.normal(size=14_000))])
    label = (x[:, 0] - x[:, 2] + rng.normal(size=14_000) > 2.5).astype(float)
    rows = spark.createDataFrame([(Vectors.dense(v), float(y), 12.25 if y else 1.0) for v, y in zip(x, label)], ["plain", "label", "weight"]).repartition(3).cache()
    asked = {**PARAMS, "maxDepth": 3, "maxIter": 4, "stepSize": 0.3}
    assert _apart(rows, boosting.GBTClassifier(**asked).fit(rows), ml.GBTClassifier(**asked).fit(rows)) < 1e-9


def test_many_tasks_give_the_trees_of_one(rows, monkeypatch):
    asked = {**PARAMS, "maxDepth": 3, "maxIter": 5, "stepSize": 0.3}
    one = boosting.GBTClassifier(**asked).fit(rows)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 700)
    assert [t.toDebugString.split("\n")[1:] for t in boosting.GBTClassifier(**asked).fit(rows).trees] == [
        t.toDebugString.split("\n")[1:] for t in one.trees]


def test_a_small_table_trains_without_a_job_for_each_level(spark, rows):
    spark.sparkContext.setJobGroup("few jobs", "training")
    try:
        boosting.GBTClassifier(**PARAMS, maxDepth=2, maxIter=60).fit(rows)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs")) < 60
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_constant_features_and_weights_that_differ_within_a_class(spark):
    plain = spark.createDataFrame([(Vectors.dense([1.0]), float(i % 2), 1.0 + i % 2) for i in range(40)], ["plain", "label", "weight"])
    asked = {**PARAMS, "maxDepth": 2, "maxIter": 3}
    assert [t.numNodes for t in boosting.GBTClassifier(**asked).fit(plain).trees] == [1, 1, 1]
    mixed = spark.createDataFrame([(Vectors.dense([float(i)]), float(i > 20), 1.0 + i % 3) for i in range(40)], ["plain", "label", "weight"])
    assert _apart(mixed, boosting.GBTClassifier(**asked).fit(mixed), ml.GBTClassifier(**asked).fit(mixed)) == 0
