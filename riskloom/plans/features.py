"""Point-in-time feature frame of every transaction (customer timeline + daily baselines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.functions import amount_zscore
from riskloom.operators.asof import asof_previous_day
from riskloom.operators.baselines import customer_daily, merchant_daily
from riskloom.operators.slices import US_PER_DAY, US_PER_MINUTE, Slicing, plan_slices
from riskloom.operators.timeline import Trailing, entity_timeline
from riskloom.sources.star import Star, located

# Trailing windows in minutes.
VELOCITY_SHORT_MIN, VELOCITY_LONG_MIN, FAILED_WINDOW_MIN = 10, 60, 15

CUSTOMER_BASELINE = [
    "txn_amount_avg_90d", "txn_amount_stddev_90d", "distinct_merchants_30d", "distinct_devices_30d",
]
MERCHANT_BASELINE = ["avg_txn_amount_90d", "chargeback_rate_90d"]

FEATURES = [
    "customer_baseline_avg_90d", "customer_baseline_stddev_90d", "customer_distinct_merchants_30d",
    "customer_distinct_devices_30d", "amount_zscore", "merchant_avg_amount_90d", "merchant_chargeback_rate_90d",
    "txn_count_today_so_far", "distinct_merchants_today", "seconds_since_last_txn", "txn_count_last_10min",
    "txn_count_last_60min", "recent_failed_count_15min", "is_new_device", "is_new_location",
    "is_first_time_at_merchant", "last_location_id", "last_location_lat", "last_location_lon", "last_txn_ts_any",
    "current_location_lat", "current_location_lon", "txns_at_this_hour", "total_prior_txns",
    "has_sufficient_history",
]

FIRST_OF = {
    "device": ["device_id"], "location": ["location_id"], "merchant": ["merchant_id"],
    "merchant_today": ["merchant_id", "day"],
}


def micro_windows(short_min: int = VELOCITY_SHORT_MIN, long_min: int = VELOCITY_LONG_MIN,
                  failed_min: int = FAILED_WINDOW_MIN) -> dict[str, Trailing]:
    return {
        "txn_count_last_10min": Trailing(short_min * US_PER_MINUTE),
        "txn_count_last_60min": Trailing(long_min * US_PER_MINUTE),
        "recent_failed_count_15min": Trailing(failed_min * US_PER_MINUTE, "status = 'FAILED'"),
    }


def customer_slices(star: Star, **kw) -> Slicing:
    return plan_slices(star.txn, "customer_id", US_PER_DAY, whole=True, **kw)


def baseline_asof_customers(txn: DataFrame, daily: DataFrame) -> DataFrame:
    return asof_previous_day(
        txn.select("customer_id", "day"), daily.withColumnRenamed("metric_date", "day"),
        "customer_id", "day", CUSTOMER_BASELINE)


def baseline_asof_merchants(txn: DataFrame, daily: DataFrame) -> DataFrame:
    return asof_previous_day(
        txn.select("merchant_id", "day"), daily.withColumnRenamed("metric_date", "day"),
        "merchant_id", "day", MERCHANT_BASELINE).drop("matched")


def transaction_features(
    star: Star, *, customers: DataFrame | None = None, merchants: DataFrame | None = None,
    slicing: Slicing | None = None, extra_trailing: dict[str, Trailing] | None = None,
    windows: dict[str, Trailing] | None = None,
) -> DataFrame:
    """One row per located transaction with the 25 point-in-time features.

    ``customers`` / ``merchants``: materialised daily baselines (computed here when absent).
    ``extra_trailing``: more trailing counts to take from the same timeline pass.
    """
    customers = customers if customers is not None else customer_daily(star.txn)
    merchants = merchants if merchants is not None else merchant_daily(star.txn, star.labels)
    slicing = slicing or customer_slices(star)
    txn = located(star).withColumn("where_at", F.struct(
        "location_id", F.col("current_location_lat").alias("lat"), F.col("current_location_lon").alias("lon")))
    trailing = {**(windows or micro_windows()), **(extra_trailing or {})}
    line = entity_timeline(txn, slicing, trailing, first_of=FIRST_OF, hours=True)
    line = line.join(baseline_asof_customers(txn, customers), ["customer_id", "day"], "left")
    line = line.join(baseline_asof_merchants(txn, merchants), ["merchant_id", "day"], "left")
    amount = F.col("amount").cast("double")
    mean, spread = F.col("txn_amount_avg_90d").cast("double"), F.col("txn_amount_stddev_90d").cast("double")
    kept = [c for c in star.txn.columns if c != "amount"]
    return line.select(
        *kept,
        amount.alias("amount"),
        mean.alias("customer_baseline_avg_90d"),
        spread.alias("customer_baseline_stddev_90d"),
        F.col("distinct_merchants_30d").cast("long").alias("customer_distinct_merchants_30d"),
        F.col("distinct_devices_30d").cast("long").alias("customer_distinct_devices_30d"),
        amount_zscore(amount, mean, spread).alias("amount_zscore"),
        F.col("avg_txn_amount_90d").cast("double").alias("merchant_avg_amount_90d"),
        F.col("chargeback_rate_90d").cast("double").alias("merchant_chargeback_rate_90d"),
        F.col("today_count").alias("txn_count_today_so_far"),
        F.col("today_merchants").alias("distinct_merchants_today"),
        ((F.col("ts_us") - F.col("today_last_us")) / 1_000_000).alias("seconds_since_last_txn"),
        "txn_count_last_10min", "txn_count_last_60min", "recent_failed_count_15min",
        F.col("first_device").alias("is_new_device"),
        F.col("first_location").alias("is_new_location"),
        F.col("first_merchant").alias("is_first_time_at_merchant"),
        F.col("prev_where.location_id").alias("last_location_id"),
        F.col("prev_where.lat").alias("last_location_lat"),
        F.col("prev_where.lon").alias("last_location_lon"),
        F.timestamp_micros("prev_us").alias("last_txn_ts_any"),
        "current_location_lat", "current_location_lon",
        F.col("hour_count").alias("txns_at_this_hour"),
        F.col("prior_count").alias("total_prior_txns"),
        F.coalesce("matched", F.lit(False)).alias("has_sufficient_history"),
        F.col("first_us"), F.col("prev_us"),
        *[n for n in (extra_trailing or {})],
    )
