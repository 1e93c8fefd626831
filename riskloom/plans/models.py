"""Supervised models: balanced logistic regression and boosted trees, both as MLlib's models."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from riskloom.plans.boosting import Binned, GBTClassifier
from riskloom.plans.evaluation import full_evaluation, ranking_summary, score_curve, top_k_threshold
from riskloom.plans.forest import Forest, with_train_only_score
from riskloom.plans.matrix import NUMERIC
from riskloom.plans.preprocess import Preprocessor, fit_preprocessor
from riskloom.session import ROWS_PER_TASK, cut_lineage

# The three boosted-tree configurations.
GRID = [
    {"maxDepth": 3, "maxIter": 150, "stepSize": 0.1},
    {"maxDepth": 4, "maxIter": 200, "stepSize": 0.1},
    {"maxDepth": 5, "maxIter": 300, "stepSize": 0.05},
]
SEED = 42


def _weighted(train: DataFrame, positive_weight: float, negative_weight: float) -> DataFrame:
    label = F.col("is_fraud").cast("double")
    return train.withColumn("label", label).withColumn(
        "weight", F.when(F.col("is_fraud"), positive_weight).otherwise(negative_weight))


def class_counts(train: DataFrame) -> tuple[int, int]:
    row = train.agg(F.count_if("is_fraud"), F.count_if(~F.col("is_fraud"))).first()
    return row[0], row[1]


def fit_logistic(train: DataFrame, features: str = "scaled") -> LogisticRegressionModel:
    """Balanced class weights (they sum to n) and an L2 penalty of 1/n; the intercept is free."""
    positives, negatives = class_counts(train)
    n = positives + negatives
    weighted = _weighted(train, n / (2 * max(positives, 1)), n / (2 * max(negatives, 1)))
    return LogisticRegression(
        featuresCol=features, labelCol="label", weightCol="weight", regParam=1.0 / n, elasticNetParam=0.0,
        standardization=False, maxIter=2000, tol=1e-6).fit(weighted)


@dataclass(frozen=True)
class BoostedSelection:
    model: GBTClassificationModel
    trials: DataFrame


def fit_boosted(
    train: DataFrame, validation: DataFrame, grid: list[dict] | None = None, features: str = "plain",
) -> BoostedSelection:
    """Tries each configuration, keeps the best average precision on validation (first on a tie).

    The configurations are independent and train at the same time, on the same codes of the rows: a level of a tree is a
    short job, and the jobs of one configuration alone leave cores idle.
    """
    positives, negatives = class_counts(train)
    weighted = cut_lineage(_weighted(train, negatives / positives if positives else 1.0, 1.0).select(features, "label", "weight"))
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, -(-(positives + negatives) // ROWS_PER_TASK))
    rows = weighted.coalesce(tasks)
    tried = grid or GRID
    learners = [GBTClassifier(featuresCol=features, labelCol="label", weightCol="weight", seed=SEED, **params) for params in tried]
    binned = Binned.of(rows, features, "label", "weight", SEED, learners[0].getMaxBins())

    def trial(learner: GBTClassifier) -> tuple[GBTClassificationModel, float]:
        model = learner.fit(rows if binned is None else binned)
        curve = score_curve(with_probability(validation, model, "_p"), "_p")
        return model, float(ranking_summary(curve).first()["pr_auc"] or 0.0)

    with ThreadPool(len(learners)) as pool:
        found = pool.map(inheritable_thread_target(train.sparkSession)(trial), learners)
    if binned is not None:
        binned.base.unpersist()
    best, _ = max(found, key=lambda f: f[1])  # the first of equal ones
    trials = [(p["maxDepth"], p["maxIter"], p["stepSize"], score) for p, (_, score) in zip(tried, found)]
    report = train.sparkSession.createDataFrame(
        trials, "max_depth int, trees int, step_size double, validation_pr_auc double")
    return BoostedSelection(best, report)


def with_probability(df: DataFrame, model, into: str) -> DataFrame:
    """The positive class's probability; the model's other output columns are dropped."""
    scored = model.transform(df)
    probability = vector_to_array(F.col(model.getProbabilityCol()))[1]
    return scored.withColumn(into, probability).drop(
        model.getProbabilityCol(), model.getRawPredictionCol(), model.getPredictionCol())


@dataclass(frozen=True)
class Prepared:
    """Matrix with split, train-only forest score and both encodings (``plain``, ``scaled``)."""

    rows: DataFrame
    preprocessor: Preprocessor
    forest: Forest

    def part(self, split: str) -> DataFrame:
        return self.rows.filter(F.col("split") == split)


def prepare(matrix: DataFrame, **forest) -> Prepared:
    """``matrix`` with ``split``: train-only forest, then train-only encoding constants."""
    fitted, scored = with_train_only_score(matrix, **forest)
    pre = fit_preprocessor(scored.filter("split = 'train'"), NUMERIC + ["isolation_forest_score"])
    rows = pre.transform(pre.transform(scored, False, "plain"), True, "scaled")
    return Prepared(cut_lineage(rows), pre, fitted)


def evaluate_model(prepared: Prepared, model, name: str) -> DataFrame:
    """Threshold (top 2 % of validation) chosen on validation, then both splits evaluated."""
    scored = cut_lineage(with_probability(prepared.rows.filter("split <> 'train'"), model, "score"))
    validation = scored.filter("split = 'validation'")
    threshold = top_k_threshold(score_curve(validation))
    parts = [full_evaluation(scored.filter(F.col("split") == s), threshold).withColumn("split", F.lit(s))
             for s in ("validation", "test")]
    return parts[0].unionByName(parts[1]).withColumn("model", F.lit(name))
