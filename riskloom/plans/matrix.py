"""The model's feature matrix: features, statistics, rule aggregates, attributes, label."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.operators.timeline import Trailing
from riskloom.plans.anomaly import (
    AnomalySlices, frequency_windows, with_behavioral_score, with_frequency_z, with_iqr_scores,
)
from riskloom.plans.features import transaction_features
from riskloom.plans.rules import Rule, firing_aggregates, with_firings
from riskloom.schema import RULE_IDS
from riskloom.sources.star import Star, labelled

# The feature lists.
IDENTIFIERS = ["transaction_id", "customer_id", "merchant_id", "device_id", "location_id"]
NUMERIC = [
    "amount", "amount_zscore", "txn_count_last_10min", "txn_count_last_60min", "recent_failed_count_15min",
    "distinct_merchants_30d", "distinct_devices_30d", "customer_amount_iqr_score", "merchant_amount_iqr_score",
    "frequency_deviation_zscore", "hour", "rules_fired_count", "max_rule_severity",
]
BOOLEAN = ["is_new_device", "is_new_location", "is_first_time_at_merchant"] + [f"rule_fired_{r}" for r in RULE_IDS]
CATEGORICAL = ["channel", "status", "customer_risk_segment", "merchant_risk_category"]
FEATURE_COLUMNS = NUMERIC + BOOLEAN + CATEGORICAL


def with_attributes(txn: DataFrame, star: Star) -> DataFrame:
    """Customer segment and merchant category, looked up from the dimensions."""
    segment = star.customer.select("customer_id", F.col("risk_segment").alias("customer_risk_segment"))
    category = star.merchant.select("merchant_id", F.col("risk_category").alias("merchant_risk_category"))
    return txn.join(segment, "customer_id", "left").join(category, "merchant_id", "left")


def feature_matrix(
    star: Star, *, customers: DataFrame | None = None, merchants: DataFrame | None = None,
    rules: list[Rule] | None = None, slices: AnomalySlices | None = None,
    trailing: dict[str, Trailing] | None = None,
) -> DataFrame:
    """One row per located transaction: identifiers, time, label, 27 features, behavioural score.

    The minute and day-scale counts come from one timeline pass. The merchants' fraud rate is
    computed with the baselines but left out on purpose: labels arrive too late to be a feature.
    """
    slices = slices or AnomalySlices.plan(star)
    df = transaction_features(
        star, customers=customers, merchants=merchants, slicing=slices.customer_days,
        extra_trailing=trailing or frequency_windows())
    df = with_firings(df, rules)
    df = df.select("*", *firing_aggregates(F.col("firings"))).drop("firings")
    df = with_behavioral_score(with_iqr_scores(with_frequency_z(df), star, slices))
    df = df.withColumnsRenamed({
        "customer_distinct_merchants_30d": "distinct_merchants_30d",
        "customer_distinct_devices_30d": "distinct_devices_30d"})
    df = labelled(with_attributes(df, star), star.labels)
    typology = star.labels.select("transaction_id", "fraud_typology")
    return df.join(typology, "transaction_id", "left").select(
        *IDENTIFIERS, "transaction_ts", "ts_us", "day", "is_fraud", "fraud_typology", *FEATURE_COLUMNS,
        "behavioral_anomaly_score")
