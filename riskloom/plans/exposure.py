"""Financial outcome of alerting at a threshold, and the sweep over candidate thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.operators.quantile_cut import exact_quantiles

# Fixed values.
INVESTIGATION_COST_USD = 12.00
RECOVERY_RATE = 0.80


def _outcome(alerts: Column, rows: Column, tp: Column, positives: Column, tp_amount: Column,
             positive_amount: Column) -> list[Column]:
    cost, prevented = alerts * INVESTIGATION_COST_USD, tp_amount * RECOVERY_RATE
    unprevented = positive_amount - tp_amount
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return [
        alerts.alias("n_alerts"), F.try_divide(alerts, rows).alias("alert_rate"),
        tp.alias("true_positives"), (alerts - tp).alias("false_positives"),
        (positives - tp).alias("false_negatives"),
        ratio(tp, alerts).alias("precision"), ratio(tp, positives).alias("recall"),
        F.round(cost, 2).alias("total_investigation_cost_usd"),
        F.round(prevented, 2).alias("estimated_loss_prevented_usd"),
        F.round(unprevented, 2).alias("unprevented_loss_usd"),
        F.round(prevented - cost - unprevented, 2).alias("net_expected_impact_usd"),
    ]


def impact_at_thresholds(df: DataFrame, thresholds: list[float], score: str = "combined_score") -> DataFrame:
    """One outcome row per distinct threshold, highest first.

    Rows are counted by how many thresholds they reach (one pass, at most len+1 groups); the
    outcomes are suffix sums over those few groups. No row is paired with every threshold.
    """
    levels = sorted(set(thresholds))
    candidates = F.array(*[F.lit(float(t)) for t in levels])
    reached = F.size(F.filter(candidates, lambda t: F.col(score) >= t))
    amount = F.col("amount").cast("decimal(18,2)")
    groups = df.groupBy(reached.alias("level")).agg(
        F.count("*").alias("n"), F.count_if("is_fraud").alias("f"),
        F.sum(F.when(F.col("is_fraud"), amount).otherwise(0)).alias("a"))
    spine = df.sparkSession.createDataFrame(
        [(i, float(t)) for i, t in enumerate([0.0, *levels])], "level int, threshold double")
    groups = spine.join(groups, "level", "left").fillna(0, ["n", "f"]).withColumn(
        "a", F.coalesce(F.col("a").cast("double"), F.lit(0.0)))
    above = W.orderBy(F.col("level").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.orderBy(F.col("level").desc()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    summed = groups.select(
        "level", "threshold", *[F.sum(c).over(above).alias(c) for c in ("n", "f", "a")],
        *[F.sum(c).over(whole).alias(f"all_{c}") for c in ("n", "f", "a")])
    c = F.col
    return summed.filter("level > 0").select("threshold", *_outcome(
        c("n"), c("all_n"), c("f"), c("all_f"), c("a"), c("all_a"))).orderBy(F.col("threshold").desc())


def sweep_thresholds(df: DataFrame, score: str = "combined_score", n_points: int = 20) -> list[float]:
    steps = [(1 + 98 * i / (n_points - 1)) / 100 for i in range(n_points)]
    return exact_quantiles(df, [score], steps)[score]


def threshold_sweep(df: DataFrame, score: str = "combined_score", n_points: int = 20) -> DataFrame:
    """Outcomes at evenly spaced percentiles (1..99) of the score itself."""
    return impact_at_thresholds(df, sweep_thresholds(df, score, n_points), score)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep row with the highest net impact; the highest threshold among equals."""
    return sweep.orderBy(F.col("net_expected_impact_usd").desc(), F.col("threshold").desc()).limit(1)
