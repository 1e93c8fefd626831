"""Alerts from scored transactions, and the investigation cases they open."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.operators.ordering import dense_ids
from riskloom.operators.sessions import gap_sessions
from riskloom.operators.slices import US_PER_DAY, US_PER_MINUTE, Slicing, plan_slices

# Fixed values.
ALERT_TIERS = ["HIGH", "CRITICAL"]
ESCALATED_TIERS = ["CRITICAL"]
DEDUP_WINDOW_MINUTES = 60
SLA_HOURS = {"CRITICAL": 4, "HIGH": 24}


def generate_alerts(
    scores: DataFrame, txn: DataFrame, slicing: Slicing | None = None, gap_minutes: int = DEDUP_WINDOW_MINUTES,
) -> DataFrame:
    """One alert per HIGH/CRITICAL transaction; a customer's alerts within the gap share a group id.

    The group id is a hash of customer and the group's first transaction, so re-runs agree.
    """
    worthy = scores.filter(F.col("risk_tier").isin(ALERT_TIERS)).select("transaction_id", "risk_tier", "combined_score")
    facts = txn.select("transaction_id", "customer_id", "transaction_ts", "ts_us", "amount")
    alerts = facts.join(worthy, "transaction_id")
    slicing = slicing or plan_slices(txn, "customer_id", US_PER_DAY)
    grouped = gap_sessions(alerts, slicing, gap_minutes * US_PER_MINUTE)
    start = F.concat_ws("|", "customer_id", "session_start.id")
    shaped = grouped.select(
        "transaction_id", "customer_id", "risk_tier", "combined_score",
        F.col("amount").cast("decimal(14,2)").alias("financial_exposure"),
        F.concat(F.lit("DEDUP-"), F.left(F.sha2(start, 256), F.lit(12))).alias("dedup_group_id"),
        F.col("transaction_ts").alias("created_at"), F.col("ts_us").alias("created_us"))
    return dense_ids(shaped, "alert_id", [F.col("created_us"), F.col("transaction_id")])


def generate_cases(alerts: DataFrame, ids_are_dense: bool = True) -> DataFrame:
    """One case per alert: CRITICAL opens escalated, deadline by tier, numbered in alert order."""
    if ids_are_dense:
        alerts = alerts.withColumn("case_id", F.col("alert_id"))
    else:
        alerts = dense_ids(alerts, "case_id", [F.col("alert_id")])
    hours = F.lit(None).cast("int")
    for tier, limit in SLA_HOURS.items():
        hours = F.when(F.col("risk_tier") == tier, limit).otherwise(hours)
    return alerts.select(
        "case_id", "alert_id", "customer_id",
        F.when(F.col("risk_tier").isin(ESCALATED_TIERS), "ESCALATED").otherwise("OPEN").alias("status"),
        F.lit(None).cast("string").alias("assigned_investigator"),
        (F.col("created_at") + F.make_interval(hours=hours)).alias("sla_deadline"),
        F.lit(None).cast("string").alias("resolution"),
        "created_at", F.lit(None).cast("timestamp").alias("resolved_at"), "risk_tier")


def alert_volume(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """Alerts, distinct groups, alerts absorbed by grouping, and the fraud rate among them."""
    flags = labels.select("transaction_id", "is_fraud")
    return alerts.join(flags, "transaction_id", "left").agg(
        F.count("*").alias("alerts"), F.count_distinct("dedup_group_id").alias("dedup_groups"),
        F.count_if(F.col("risk_tier") == "CRITICAL").alias("critical_alerts"),
        F.count_if(F.col("risk_tier") == "HIGH").alias("high_alerts"),
        F.avg(F.coalesce("is_fraud", F.lit(False)).cast("int")).alias("alerted_fraud_rate"),
    ).withColumn("absorbed", F.col("alerts") - F.col("dedup_groups"))
