"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The driver tables are first stored as a star schema (not timed, like loading a database); each job
then runs once to warm up and three times for the reported median.
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import sys
import tempfile
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from riskloom import jobs  # noqa: E402
from riskloom.plans import alerts as A, cases as C, exposure as X, reports as R, rules as U  # noqa: E402
from riskloom.plans.anomaly import statistical_features  # noqa: E402
from riskloom.plans.features import transaction_features  # noqa: E402
from riskloom.plans.models import fit_logistic, prepare, with_probability  # noqa: E402
from riskloom.plans.scoring import risk_scores, score_transactions  # noqa: E402
from riskloom.session import build_session, cut_lineage  # noqa: E402
from riskloom.sources import read_star, read_table, star_from_driver_tables  # noqa: E402

RUNS = 3


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    jobs.load_star(star_from_driver_tables(spark, sf_dir), root, files=int(cpus))
    star = read_star(spark, root)

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def daily_baselines():
        jobs.run_baselines(spark, root)

    def batch_rules():
        run(U.apply_rules(transaction_features(star, **jobs._baselines(spark, root))))

    def statistics_iqr_frequency():
        run(statistical_features(star))

    def statistics_with_forest():
        jobs.run_statistics(spark, root).collect()

    def risk_scoring_logistic():
        """Whole scoring job with the linear model as ML component."""
        matrix = jobs.split_matrix(star, **jobs._baselines(spark, root))
        prepared = prepare(matrix)
        model = fit_logistic(prepared.part("train"))
        rows = with_probability(prepared.rows, model, "ml_probability")
        scored, _ = score_transactions(rows, F.col("ml_probability"), F.col("isolation_forest_score"))
        scored = cut_lineage(scored)
        jobs.sinks.full_refresh(jobs.as_stored(risk_scores(scored), "risk_scores"), f"{root}/risk_scores")
        X.best_threshold(X.threshold_sweep(scored.filter("split = 'validation'"))).collect()

    def alerts_and_cases():
        jobs.run_investigation(spark, root).collect()

    def dashboard_kpis():
        alerts, cases = read_table(spark, root, "fraud_alerts"), read_table(spark, root, "investigation_cases")
        R.executive_kpis(star.txn, star.labels, alerts, cases).collect()
        R.tier_distribution(read_table(spark, root, "risk_scores")).collect()

    timings: dict[str, float] = {}
    for job in (daily_baselines, batch_rules, statistics_iqr_frequency, statistics_with_forest, risk_scoring_logistic,
                alerts_and_cases, dashboard_kpis):
        job()
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            job()
            times.append(time.perf_counter() - start)
        timings[job.__name__] = round(statistics.median(times), 3)
        print(f"{job.__name__}: {timings[job.__name__]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_jobs_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": float(pathlib.Path(sf_dir).name.removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
