"""Financial sweep, ranking metrics, distributions."""

import numpy as np
import pandas as pd
import pytest

from riskloom.plans import evaluation as E, exposure as X

SCORED = "transaction_id long, score double, amount double, is_fraud boolean"


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame(
        [(1, .9, 100., True), (2, .8, 50., False), (3, .3, 200., True), (4, .1, 10., False)], SCORED)


def test_impact(four):
    r = X.impact_at_thresholds(four, [0.5], "score").first()
    assert (r.n_alerts, r.true_positives, r.false_positives, r.false_negatives) == (2, 1, 1, 1)
    assert (r.total_investigation_cost_usd, r.estimated_loss_prevented_usd, r.unprevented_loss_usd,
            r.net_expected_impact_usd) == (24, 80, 200, -144)


def test_impact_above_all_scores(four):
    r = X.impact_at_thresholds(four, [2.0], "score").first()
    assert (r.n_alerts, r.precision, r.recall) == (0, 0.0, 0.0)


def test_sweep_and_best(spark):
    df = spark.createDataFrame(
        [(i, float(s), 50.0, i % 20 == 0) for i, s in enumerate(np.linspace(0, 1, 100))], SCORED)
    sweep = X.threshold_sweep(df, "score", 10).toPandas()
    assert len(sweep) == 10 and sweep["threshold"].is_monotonic_decreasing and sweep["n_alerts"].is_monotonic_increasing
    np.testing.assert_allclose(sorted(sweep["threshold"]), np.percentile(np.linspace(0, 1, 100), np.linspace(1, 99, 10)))
    best = X.best_threshold(X.threshold_sweep(df, "score", 10)).first()
    top = sweep.sort_values(["net_expected_impact_usd", "threshold"], ascending=False).iloc[0]
    assert best.threshold == top.threshold


def frame(spark, y, s):
    return spark.createDataFrame([(i, float(b), 1.0, bool(a)) for i, (a, b) in enumerate(zip(y, s))], SCORED)


def test_threshold_metrics(spark):
    df = frame(spark, [1, 1, 1, 0, 0, 0, 0, 0], [.9, .8, .2, .7, .6, .1, .1, .1])
    r = E.metrics_at_threshold(df, 0.5).first()
    assert (r.precision, r.recall) == (pytest.approx(2 / 4), pytest.approx(2 / 3))
    r = E.metrics_at_threshold(frame(spark, [1, 1, 0, 0], [.9, .1, .9, .1]), 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1)


def test_top_k(spark):
    df = frame(spark, [1, 0, 1, 0, 0, 0, 0, 0, 0, 0], [.9, .8, .7, .6, .5, .4, .3, .2, .1, .05])
    r = E.precision_recall_at_top_k(df, E.score_curve(df), 0.2).first()
    assert (r.k, r.precision, r.recall) == (2, 0.5, 0.5)
    five = frame(spark, [0] * 5, [.1, .9, .5, .3, .95])
    assert E.top_k_threshold(E.score_curve(five), 0.2) == 0.95


def test_top_k_splits_ties_by_id(spark):
    df = frame(spark, [0, 1, 1, 0, 1], [.5] * 5)
    r = E.precision_recall_at_top_k(df, E.score_curve(df), 0.6).first()
    assert (r.k, r.precision) == (3, pytest.approx(2 / 3))


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(0)
    y, s = rng.random(300) < 0.2, np.round(rng.random(300), 1)
    r = E.ranking_summary(E.score_curve(frame(spark, y, s))).first()
    pos, neg = s[y], s[~y]
    auc = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    curve = pd.DataFrame({"y": y, "s": s}).groupby("s").agg(n=("y", "size"), p=("y", "sum")).sort_index(ascending=False)
    ap = ((curve.p / y.sum()) * (curve.p.cumsum() / curve.n.cumsum())).sum()
    assert (r.roc_auc, r.pr_auc) == (pytest.approx(auc), pytest.approx(ap))


def test_no_point_below_the_fpr_target(spark):
    r = E.recall_at_fixed_fpr(E.score_curve(frame(spark, [0, 1], [.9, .1])), 0.01).first()
    assert (r.recall, r.actual_fpr, r.threshold) == (0.0, 0.0, float("inf"))


def test_distribution_of_each_class(spark):
    df = frame(spark, [1, 0, 0, 0], [.5, .1, .2, .6])
    rows = {r.is_fraud: r for r in E.score_distribution(df).collect()}
    assert rows[False]["p50"] == pytest.approx(0.2) and rows[True]["count"] == 1 and rows[True]["std"] is None


def test_histogram_top_edge(spark):
    got = {(r.is_fraud, r.bin): r.n for r in E.score_histogram(frame(spark, [0, 0, 1], [0.0, 1.0, 0.5])).collect()}
    assert got == {(False, 0): 1, (False, 39): 1, (True, 20): 1}
