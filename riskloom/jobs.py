"""The batch jobs, from stored star tables to stored results: python -m riskloom.jobs <job> <root>

Every job reads parquet tables under ``root`` and replaces the tables it owns there, so a job can be
repeated. Order: baselines, rules, statistics, scoring, training, investigation.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.operators.baselines import changed_daily, customer_daily, merchant_daily
from riskloom.operators.ordering import chronological_split
from riskloom.plans import alerts as A, cases as C, evaluation as E, exposure as X, rules as U
from riskloom.plans.anomaly import (
    AnomalySlices, frequency_windows, with_behavioral_score, with_frequency_z, with_iqr_scores,
)
from riskloom.plans.attribution import global_importance, top_contributors, tree_contributions
from riskloom.plans.features import transaction_features
from riskloom.plans.forest import with_whole_data_score
from riskloom.plans.matrix import feature_matrix
from riskloom.plans.model_store import FittedModels
from riskloom.plans.models import evaluate_model, fit_boosted, fit_logistic, prepare, with_probability
from riskloom.plans.scoring import risk_scores, score_transactions, tier_fraud_check
from riskloom.schema import TABLES
from riskloom.session import build_session, cut_lineage, tune
from riskloom.sources import Star, read_star, read_table, sinks
from riskloom.sources.star import labelled, located

SEGMENTS = ["channel", "customer_risk_segment", "merchant_risk_category", "fraud_typology"]


def as_stored(df: DataFrame, table: str) -> DataFrame:
    """Columns and types of the declared table; decimals are rounded half up on write."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table]])


def load_star(star: Star, root: str, files: int | None = None) -> None:
    """Full refresh of the base tables; the facts are clustered by customer and time."""
    for name, df in (("dim_customer", star.customer), ("dim_merchant", star.merchant), ("dim_device", star.device),
                     ("dim_location", star.location), ("fact_transactions", star.txn), ("ground_truth_fraud", star.labels)):
        known = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                 for f in TABLES[name]]
        out = df.select(*known)
        if name == "fact_transactions":
            sinks.clustered_refresh(out, f"{root}/{name}", ["customer_id", "transaction_ts"], ["transaction_id", "merchant_id"], files)
            continue
        if files and name == "ground_truth_fraud":
            out = out.repartition(files)
        sinks.full_refresh(out, f"{root}/{name}")


def run_baselines(spark: SparkSession, root: str) -> DataFrame:
    star = read_star(spark, root)
    return sinks.refresh_baselines(
        spark, lambda: customer_daily(star.txn), lambda: merchant_daily(star.txn, star.labels), root)


def refresh_changed_days(spark: SparkSession, star: Star, changed: DataFrame, root: str) -> DataFrame:
    """Both daily tables after some transactions changed; a one-row report of the rows computed and the days rewritten.

    ``changed``: customer_id, merchant_id and day of the transactions that came, went or were altered.
    """
    started, report = time.monotonic(), {}
    for name, compute in (("customer", customer_daily), ("merchant", lambda txn: merchant_daily(txn, star.labels))):
        key = f"{name}_id"
        rows, replaced = changed_daily(star.txn, changed, key, compute)
        rows = cut_lineage(rows)
        days = sinks.replace_keys_of_days(rows, replaced, f"{root}/fact_{name}_daily_metrics", key)
        report[f"{name}_rows"], report[f"{name}_days"] = rows.count(), len(days)
    return spark.range(1).select(*[F.lit(v).cast("long").alias(n) for n, v in report.items()],
                                 F.lit(time.monotonic() - started).alias("elapsed_seconds"))


def _baselines(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {"customers": read_table(spark, root, "fact_customer_daily_metrics"),
            "merchants": read_table(spark, root, "fact_merchant_daily_metrics")}


def split_matrix(star: Star, **baselines: DataFrame) -> DataFrame:
    """Feature matrix with its split, written once: the split's borders come from the narrow facts."""
    keys = located(star).select("ts_us", "transaction_id")
    return cut_lineage(chronological_split(feature_matrix(star, **baselines), keys=keys))


def run_rules(spark: SparkSession, root: str) -> DataFrame:
    star = read_star(spark, root)
    firings = U.apply_rules(transaction_features(star, **_baselines(spark, root)))
    sinks.full_refresh(as_stored(firings, "rules_triggered"), f"{root}/rules_triggered")
    return U.run_summary(read_table(spark, root, "rules_triggered"), star.txn)


def run_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Behavioural scores and a whole-data forest, evaluated against the labels afterwards."""
    star = read_star(spark, root)
    slices = AnomalySlices.plan(star)
    features = transaction_features(
        star, **_baselines(spark, root), slicing=slices.customer_days, extra_trailing=frequency_windows())
    rows = with_behavioral_score(with_iqr_scores(with_frequency_z(features), star, slices)).withColumnsRenamed({
        "customer_distinct_merchants_30d": "distinct_merchants_30d",
        "customer_distinct_devices_30d": "distinct_devices_30d"})
    scored = with_whole_data_score(cut_lineage(rows)).select(
        "transaction_id", "customer_amount_iqr_score", "merchant_amount_iqr_score", "frequency_deviation_zscore",
        "behavioral_anomaly_score", "isolation_forest_score")
    sinks.full_refresh(scored, f"{root}/behavioral_features")
    judged = labelled(spark.read.parquet(f"{root}/behavioral_features"), star.labels)
    return E.unsupervised_evaluation(judged, "behavioral_anomaly_score").unionByName(
        E.unsupervised_evaluation(judged, "isolation_forest_score"))


def run_scoring(spark: SparkSession, root: str, grid: list[dict] | None = None) -> DataFrame:
    """Forest and boosted trees on train, components, tiers, sweep on validation, one look at test."""
    star = read_star(spark, root)
    matrix = split_matrix(star, **_baselines(spark, root))
    prepared = prepare(matrix)
    boosted = fit_boosted(prepared.part("train"), prepared.part("validation"), grid)
    rows = with_probability(prepared.rows, boosted.model, "ml_probability")
    scored, constants = score_transactions(rows, F.col("ml_probability"), F.col("isolation_forest_score"))
    scored = cut_lineage(scored)
    FittedModels.of(prepared, boosted.model, constants).save(spark, f"{root}/models")
    sinks.full_refresh(as_stored(risk_scores(scored), "risk_scores"), f"{root}/risk_scores")
    sinks.write_report(tier_fraud_check(scored), f"{root}/reports/tier_fraud_rate")
    sweep = cut_lineage(X.threshold_sweep(scored.filter("split = 'validation'")))
    sinks.write_report(sweep, f"{root}/reports/threshold_sweep")
    best = X.best_threshold(sweep).first()["threshold"]
    return X.impact_at_thresholds(scored.filter("split = 'test'"), [best]).withColumns({
        "exposure_cap_usd": F.lit(constants.exposure_cap),
        **{f"cut_{t.lower()}": F.lit(v) for t, v in constants.tier_cutpoints.items()}})


def run_training(spark: SparkSession, root: str, grid: list[dict] | None = None) -> DataFrame:
    """Both models evaluated on validation and test, attributions, errors by segment."""
    star = read_star(spark, root)
    matrix = split_matrix(star, **_baselines(spark, root))
    prepared = prepare(matrix)
    logistic = fit_logistic(prepared.part("train"))
    boosted = fit_boosted(prepared.part("train"), prepared.part("validation"), grid)
    results = cut_lineage(evaluate_model(prepared, logistic, "logistic").unionByName(
        evaluate_model(prepared, boosted.model, "boosted")))
    threshold = results.filter("model = 'boosted' and split = 'test'").first()["threshold"]
    test = with_probability(prepared.part("test"), boosted.model, "score")
    explained = cut_lineage(tree_contributions(prepared.part("test"), boosted.model))
    names = prepared.preprocessor.names
    for name, df in (
        ("model_results", results), ("model_trials", boosted.trials), ("split_summary", E.split_summary(matrix)),
        ("error_analysis", E.error_analysis(test, threshold, SEGMENTS)), ("importance", global_importance(explained, names)),
        ("explanations", top_contributors(explained, names)),
    ):
        sinks.write_report(df, f"{root}/reports/{name}")
    return results


def run_investigation(spark: SparkSession, root: str) -> DataFrame:
    """Alerts and opened cases; replays the action log if there is one; operational metrics."""
    star = read_star(spark, root)
    alerts = A.generate_alerts(read_table(spark, root, "risk_scores"), star.txn)
    sinks.full_refresh(as_stored(alerts, "fraud_alerts"), f"{root}/fraud_alerts")
    cases = A.generate_cases(alerts)
    log_path = f"{root}/case_action_requests"
    if _exists(spark, log_path):
        log = spark.read.parquet(log_path)
        replayed = cut_lineage(C.replay(cases, log))
        cases = C.case_state(cases, replayed)
        for name, rows in (("audit_log", C.audit_rows(replayed)), ("investigation_actions", C.accepted_actions(replayed))):
            path = f"{root}/{name}"
            sinks.append_new(rows, spark.read.parquet(path) if _exists(spark, path) else None, path, ["case_id", "seq"])
        sinks.full_refresh(C.rejected_actions(replayed), f"{root}/rejected_actions")
    cases = cut_lineage(cases)
    sinks.full_refresh(as_stored(cases, "investigation_cases"), f"{root}/investigation_cases")
    now = star.txn.agg(F.max("transaction_ts")).first()[0]
    return C.case_metrics(cases, F.lit(now))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "baselines": run_baselines, "rules": run_rules, "statistics": run_statistics, "scoring": run_scoring,
    "training": run_training, "investigation": run_investigation,
}


def main() -> None:
    parser = argparse.ArgumentParser(prog="riskloom.jobs", description=__doc__)
    parser.add_argument("job", choices=[*JOBS, "all"])
    parser.add_argument("root", help="folder of the star tables")
    args = parser.parse_args()
    spark = tune(build_session(f"riskloom-{args.job}"))
    for name in JOBS if args.job == "all" else [args.job]:
        report = JOBS[name](spark, args.root)
        sinks.write_report(report, f"{args.root}/reports/{name}")


if __name__ == "__main__":
    main()
