"""Robust statistics per transaction: IQR fences, Poisson frequency, behavioural anomaly score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskloom.functions import behavioral_anomaly, iqr_upper_outlier, poisson_frequency_z
from riskloom.operators.quantiles import trailing_quantiles_asof
from riskloom.operators.slices import US_PER_DAY, Slicing, plan_slices
from riskloom.operators.timeline import Trailing, entity_timeline
from riskloom.sources.star import Star, located

# Windows in days.
SHORT_DAYS, LONG_DAYS = 7, 90


def frequency_windows(short_days: int = SHORT_DAYS, long_days: int = LONG_DAYS) -> dict[str, Trailing]:
    return {"count_7d_prior": Trailing(short_days * US_PER_DAY), "count_90d_prior": Trailing(long_days * US_PER_DAY)}


@dataclass(frozen=True)
class AnomalySlices:
    """Slicing of the three per-entity computations; hot entities are looked up once."""

    customer_days: Slicing
    customer_windows: Slicing
    merchant_windows: Slicing

    @staticmethod
    def plan(star: Star, window_days: int = LONG_DAYS, **kw) -> AnomalySlices:
        width = window_days * US_PER_DAY
        return AnomalySlices(
            plan_slices(star.txn, "customer_id", US_PER_DAY, whole=True, **kw),
            plan_slices(star.txn, "customer_id", width, **kw),
            plan_slices(star.txn, "merchant_id", width, **kw),
        )


def with_iqr_scores(df: DataFrame, star: Star, slices: AnomalySlices) -> DataFrame:
    """Adds customer_amount_iqr_score and merchant_amount_iqr_score to ``df`` (needs ``amount``)."""
    txn = located(star).select("transaction_id", "customer_id", "merchant_id", "ts_us", "amount")
    for who, slicing in (("customer", slices.customer_windows), ("merchant", slices.merchant_windows)):
        quantiles = trailing_quantiles_asof(txn, slicing).withColumnsRenamed(
            {c: f"{who}_{c}" for c in ("q1", "median", "q3", "prior_count")})
        df = df.join(quantiles, "transaction_id", "left").withColumn(
            f"{who}_amount_iqr_score",
            iqr_upper_outlier(F.col("amount").cast("double"), F.col(f"{who}_q1"), F.col(f"{who}_q3"),
                              F.col(f"{who}_prior_count")))
    return df


def with_frequency_z(df: DataFrame) -> DataFrame:
    """Adds frequency_deviation_zscore from the trailing counts and first/previous times."""
    active_days = (F.col("prev_us") - F.col("first_us")) / US_PER_DAY
    return df.withColumn("frequency_deviation_zscore", poisson_frequency_z(
        F.col("count_7d_prior"), F.col("count_90d_prior"), active_days))


def with_behavioral_score(df: DataFrame) -> DataFrame:
    return df.withColumn("behavioral_anomaly_score", behavioral_anomaly(
        F.col("customer_amount_iqr_score"), F.col("merchant_amount_iqr_score"), F.col("frequency_deviation_zscore")))


def statistical_features(
    star: Star, *, slices: AnomalySlices | None = None, windows: dict[str, Trailing] | None = None,
) -> DataFrame:
    slices = slices or AnomalySlices.plan(star)
    txn = located(star).select("transaction_id", "customer_id", "merchant_id", "ts_us", "hour", "amount")
    line = entity_timeline(txn, slices.customer_days, windows or frequency_windows())
    scored = with_iqr_scores(with_frequency_z(line), star, slices)
    return with_behavioral_score(scored).drop("prev_where", "today_count", "today_last_us")
