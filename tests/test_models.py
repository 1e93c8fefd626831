"""Preprocessing constants, forest, boosted trees, attribution on small frames."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.plans.attribution import linear_contributions, path_contributions, top_contributors, tree_contributions
from riskloom.plans.forest import FOREST_FEATURES, fit_forest
from riskloom.plans.matrix import BOOLEAN, CATEGORICAL, FEATURE_COLUMNS, IDENTIFIERS, NUMERIC
from riskloom.plans.models import fit_boosted, fit_logistic, prepare, with_probability


@pytest.fixture(scope="module")
def matrix(spark):
    """600 rows; fraud goes with large amounts; the last 30 % (by id) carries an unseen channel."""
    i = F.col("id")
    noise = lambda k: F.pmod(F.xxhash64(F.lit(k), i), F.lit(1000)) / 1000.0
    df = spark.range(600).withColumnRenamed("id", "transaction_id").withColumn("id", F.col("transaction_id"))
    fraud = noise(0) < 0.2
    df = df.withColumn("is_fraud", fraud)
    for k, name in enumerate(NUMERIC):
        df = df.withColumn(name, (noise(k + 1) + F.when(F.col("is_fraud"), 1.0 if name == "amount" else 0.05).otherwise(0.0)))
    df = df.withColumn("amount_zscore", F.when(i % 7 != 0, F.col("amount_zscore")))
    for k, name in enumerate(BOOLEAN):
        df = df.withColumn(name, noise(100 + k) < 0.5)
    for name in CATEGORICAL:
        df = df.withColumn(name, F.when(i >= 420, "NEW").when(i % 2 == 0, "A").otherwise("B"))
    split = F.when(i < 420, "train").when(i < 510, "validation").otherwise("test")
    return df.withColumn("split", split).drop("id").cache()


@pytest.fixture(scope="module")
def prepared(matrix):
    return prepare(matrix, trees=20, tree_rows=64)


def test_no_identifier_or_label_is_a_feature():
    assert not set(FEATURE_COLUMNS) & {*IDENTIFIERS, "is_fraud", "fraud_typology", "chargeback_rate_90d"}
    assert (len(NUMERIC), len(BOOLEAN), len(CATEGORICAL)) == (13, 10, 4)


def test_constants_come_from_train_only(matrix, prepared):
    train = matrix.filter("split = 'train'").toPandas()
    pre = prepared.preprocessor
    assert pre.medians["amount_zscore"] == pytest.approx(train["amount_zscore"].median())
    filled = train["amount_zscore"].fillna(train["amount_zscore"].median())
    assert pre.mean["amount_zscore"] == pytest.approx(filled.mean()) and pre.std["amount_zscore"] == pytest.approx(filled.std(ddof=0))
    assert pre.categories["channel"] == ["A", "B"]


def test_unknown_category_is_all_zero(prepared):
    at = [prepared.preprocessor.names.index(f"channel_{v}") for v in "AB"]
    rows = prepared.part("test").select(vector_to_array("plain").alias("v")).collect()
    assert all(r.v[j] == 0.0 for r in rows for j in at)


def test_forest_is_bounded_repeatable_and_finds_outliers(spark, prepared):
    scores = prepared.rows.select("split", "isolation_forest_score").toPandas()
    assert scores["isolation_forest_score"].between(0, 1).all()
    train = scores[scores["split"] == "train"]["isolation_forest_score"]
    assert train.min() == 0 and train.max() == 1
    rng = np.random.default_rng(1)
    rows = [(i, *([9.0] * 13 if i == 500 else rng.normal(size=13).tolist())) for i in range(501)]
    df = spark.createDataFrame(rows, "transaction_id long, " + ", ".join(f"{c} double" for c in FOREST_FEATURES))
    first, again = (fit_forest(df, trees=30, tree_rows=64).score(df).orderBy("transaction_id").toPandas() for _ in range(2))
    assert first["isolation_forest_score"].idxmax() == 500
    assert first["isolation_forest_score"].tolist() == again["isolation_forest_score"].tolist()


def test_logistic_attribution_adds_up(prepared):
    model = fit_logistic(prepared.part("train"))
    told = top_contributors(linear_contributions(prepared, model), prepared.preprocessor.names)
    p = with_probability(prepared.rows, model, "p").select("transaction_id", "p")
    for r in told.join(p, "transaction_id").collect():
        assert r.predicted_margin == pytest.approx(math.log(r.p / (1 - r.p)), abs=1e-6)
        assert len(r.top_contributors) == 6


def test_boosted_trees_select_on_validation_and_attribution_adds_up(prepared):
    grid = [{"maxDepth": 1, "maxIter": 2, "stepSize": 0.1}, {"maxDepth": 3, "maxIter": 6, "stepSize": 0.3}]
    chosen = fit_boosted(prepared.part("train"), prepared.part("validation"), grid)
    trials = chosen.trials.toPandas()
    best = trials.loc[trials["validation_pr_auc"].idxmax()]
    assert len(chosen.model.treeWeights) == best["trees"] and best["validation_pr_auc"] > 0.5
    explained = tree_contributions(prepared.part("test"), chosen.model)
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)
    margins = chosen.model.transform(explained).select(total.alias("told"), vector_to_array("rawPrediction")[1].alias("raw"))
    for r in margins.collect():
        assert r.told == pytest.approx(r.raw, abs=1e-6)


def _random_tree(rng, depth, n_features):
    """Leaves of a full random tree over n_features, with cover shares; and a function that gives its value for x."""
    leaves = []

    def grow(level, seen, cover):
        if level == depth:
            leaves.append((float(rng.normal()), [(f, lo, hi, z) for f, (lo, hi, z) in seen.items()]))
            return
        f = int(rng.integers(n_features))
        lo, hi, z = seen.get(f, (-math.inf, math.inf, 1.0))
        cut, share = float(rng.uniform(max(lo, 0), min(hi, 1))), float(rng.uniform(0.2, 0.8))
        grow(level + 1, {**seen, f: (lo, cut, z * share)}, cover)
        grow(level + 1, {**seen, f: (cut, hi, z * (1 - share))}, cover)

    grow(0, {}, 1.0)
    return leaves


def _expected(leaves, x, known):
    """Value of the tree when only the known features are given."""
    return sum(v * math.prod((lo < x[f] <= hi) if f in known else z for f, lo, hi, z in path) for v, path in leaves)


def test_tree_attribution_equals_all_subsets_and_holds_at_depth(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(25, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    leaves = [leaf for _ in range(3) for leaf in _random_tree(rng, 3, 5)]
    for r in path_contributions(rows, leaves, "x", 5).collect():
        for f in range(5):
            others = [g for g in range(5) if g != f]
            want = sum(math.factorial(len(s)) * math.factorial(4 - len(s)) / math.factorial(5) *
                       (_expected(leaves, x[r.id], {*s, f}) - _expected(leaves, x[r.id], set(s)))
                       for size in range(5) for s in itertools.combinations(others, size))
            assert r.contributions[f] == pytest.approx(want, abs=1e-9)
    deep, wide = _random_tree(rng, 12, 20), rng.uniform(size=(10, 20))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "id long, x array<double>")
    for r in path_contributions(rows, deep, "x", 20).collect():
        assert r.base + sum(r.contributions) == pytest.approx(_expected(deep, wide[r.id], set(range(20))), abs=1e-6)


def test_stored_models_score_and_explain(spark, matrix, prepared, tmp_path):
    from riskloom.plans.model_store import FittedModels
    from riskloom.plans.scoring import ScoringConstants

    chosen = fit_boosted(prepared.part("train"), prepared.part("validation"), [{"maxDepth": 3, "maxIter": 3, "stepSize": 0.1}])
    fitted = FittedModels.of(prepared, chosen.model, ScoringConstants(1.0, {"CRITICAL": 0.8, "HIGH": 0.5, "MEDIUM": 0.2}))
    fitted.save(spark, f"{tmp_path}/m")
    again = FittedModels.load(spark, f"{tmp_path}/m")
    rows = matrix.withColumns({"max_rule_severity": F.lit(-1), "behavioral_anomaly_score": F.lit(0.1)}).withColumn("rules_fired_count", F.lit(0))
    new_day = rows.drop("split")
    assert sorted(map(tuple, again.score(new_day).collect())) == sorted(map(tuple, fitted.score(new_day).collect()))
    told = again.explain(new_day, spark.createDataFrame([(5,), (590,), (10**6,)], "transaction_id long"), top_n=4).collect()
    assert sorted(r.transaction_id for r in told) == [5, 590]
    for r in told:
        own = new_day.filter(F.col("transaction_id") == r.transaction_id).first()
        for c in r.top_contributors:
            if c.feature in NUMERIC and own[c.feature] is not None:
                assert c.value == pytest.approx(float(own[c.feature]))


def test_registered_queries_train_the_default_grid(spark, prepared, monkeypatch):
    """All 150, 200 and 300 trees are asked for; small ones are grown in their place to keep the test short."""
    from checks.fixtures import Workbench
    from riskloom.plans import models

    asked = []

    def small(**params):
        asked.append({k: params[k] for k in ("maxDepth", "maxIter", "stepSize")})
        return whole(**{**params, "maxDepth": 1, "maxIter": 1})

    whole = models.GBTClassifier
    monkeypatch.setattr(models, "GBTClassifier", small)
    bench = object.__new__(Workbench)
    bench.__dict__["prepared"] = prepared
    assert [r.trees for r in bench.boosted.trials.collect()] == [150, 200, 300]
    assert asked == models.GRID


def test_configurations_train_at_the_same_time(prepared, monkeypatch):
    """Each training waits until the others have begun; one after the other they would never meet."""
    import threading

    from riskloom.plans import models

    met = threading.Barrier(3, timeout=60)

    class Meeting(models.GBTClassifier):
        def fit(self, dataset, params=None):
            met.wait()
            return super().fit(dataset, params)

    monkeypatch.setattr(models, "GBTClassifier", Meeting)
    grid = [{"maxDepth": d, "maxIter": 1, "stepSize": 0.1} for d in (1, 2, 1)]
    chosen = fit_boosted(prepared.part("train"), prepared.part("validation"), grid)
    trials = chosen.trials.collect()
    assert [r.max_depth for r in trials] == [1, 2, 1]
    assert trials[0].validation_pr_auc == trials[2].validation_pr_auc
