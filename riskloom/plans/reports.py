"""Dashboard aggregates: KPIs, daily volume, tier distribution, portfolio snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.plans.alerts import ALERT_TIERS
from riskloom.plans.cases import case_metrics
from riskloom.plans.exposure import RECOVERY_RATE
from riskloom.schema import OPEN_STATUSES

__all__ = ["ALERT_TIERS", "daily_volume_and_fraud", "executive_kpis", "portfolio_snapshot", "tier_distribution"]


def executive_kpis(txn: DataFrame, labels: DataFrame, alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """Ten scalars: one aggregate per table, the one-row results put side by side."""
    t = txn.agg(F.count("*").alias("total_transactions"),
                F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("total_amount"))
    g = labels.agg(F.count_if("is_fraud").alias("frauds"))
    a = alerts.agg(F.count("*").alias("total_alerts"), F.coalesce(
        F.sum("financial_exposure"), F.lit(0)).cast("double").alias("total_financial_exposure"))
    closed = F.col("status") == "CLOSED"
    c = cases.agg(
        F.count_if(F.col("resolution") == "CONFIRMED_FRAUD").alias("confirmed_fraud"),
        F.count_if(F.col("resolution") == "FALSE_POSITIVE").alias("_fp"), F.count_if(closed).alias("_closed"),
        F.count_if(F.col("status").isin(OPEN_STATUSES)).alias("open_investigations"),
        F.count_if(closed & (F.col("resolved_at") <= F.col("sla_deadline"))).alias("_in_time"))
    confirmed = cases.filter("resolution = 'CONFIRMED_FRAUD'").select("alert_id")
    p = alerts.join(confirmed, "alert_id").agg(F.coalesce(
        F.sum("financial_exposure").cast("double") * RECOVERY_RATE, F.lit(0.0)).alias("estimated_loss_prevented"))
    # Five one-row frames side by side.
    return t.crossJoin(g).crossJoin(a).crossJoin(c).crossJoin(p).select(
        "total_transactions", "total_amount", "total_alerts", "confirmed_fraud",
        F.coalesce(F.try_divide("frauds", "total_transactions"), F.lit(0.0)).alias("true_fraud_rate"),
        "total_financial_exposure", "estimated_loss_prevented",
        F.try_divide("_fp", "_closed").alias("false_positive_rate"), "open_investigations",
        F.try_divide("_in_time", "_closed").alias("sla_compliance_rate"))


def daily_volume_and_fraud(txn: DataFrame) -> DataFrame:
    """``txn`` with ``is_fraud``."""
    return txn.groupBy("day").agg(
        F.count("*").alias("txn_count"), F.count_if("is_fraud").alias("fraud_count"),
        F.sum("amount").alias("total_amount")).orderBy("day")


def tier_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("risk_tier").agg(F.count("*").alias("n"))


def portfolio_snapshot(txn: DataFrame, alerts: DataFrame, scores: DataFrame, cases: DataFrame, now: Column) -> DataFrame:
    """Volumes, case rates and tier distribution (a map) in one row."""
    tiers = tier_distribution(scores).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("risk_tier", "n")))).alias("risk_tier_distribution"))  # one entry per tier
    overall = case_metrics(cases, now).filter("risk_tier = 'ALL'").select(
        "total_cases", "open_cases", "resolved_cases", "sla_compliance_rate", "fraud_confirmation_rate",
        "false_positive_rate")
    return (
        txn.agg(F.count("*").alias("total_transactions"))
        .crossJoin(alerts.agg(F.count("*").alias("total_alerts"))).crossJoin(overall).crossJoin(tiers)
    )
