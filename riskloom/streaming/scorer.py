"""Rule scoring of arriving transactions against strictly earlier history, which the stream keeps as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.functions import amount_zscore
from riskloom.operators.baselines import mean_and_deviation
from riskloom.operators.slices import US_PER_MINUTE
from riskloom.plans.features import FAILED_WINDOW_MIN, VELOCITY_LONG_MIN, VELOCITY_SHORT_MIN
from riskloom.plans.rules import Rule, apply_rules
from riskloom.sources.star import Star
from riskloom.streaming import history as H

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(txn: DataFrame, star: Star) -> DataFrame:
    """The columns that scoring needs, with the place of the transaction (null if unknown)."""
    place = star.location.select(
        "location_id", F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"))
    rows = txn.withColumn("cents", (F.col("amount") * 100).cast("long")).join(place, "location_id", "left")
    return rows.select(*[F.col(name).cast(of_type).alias(name) for name, of_type in (f.split() for f in H.ARRIVAL.split(", "))])


def rule_features(rows: DataFrame) -> DataFrame:
    """What the rules read, from the sums and counts that the state gives; baselines are rounded as the stored ones are."""
    mean, deviation = mean_and_deviation()
    amount = F.col("cents") / 100
    rows = rows.withColumns({"_mean": mean.cast("double"), "_deviation": deviation.cast("double")})
    of_merchant = rows.withColumns({"wn": F.col("merchant_n"), "ws": F.col("merchant_s")})
    return of_merchant.select(
        "transaction_id", "customer_id", "merchant_id", "transaction_ts", "ts_us", "hour", "status", amount.alias("amount"),
        F.col("_mean").alias("customer_baseline_avg_90d"), F.col("_deviation").alias("customer_baseline_stddev_90d"),
        amount_zscore(amount, F.col("_mean"), F.col("_deviation")).alias("amount_zscore"),
        mean_and_deviation()[0].cast("double").alias("merchant_avg_amount_90d"),
        F.col("short_count").alias("txn_count_last_10min"), F.col("long_count").alias("txn_count_last_60min"),
        F.col("failed_count").alias("recent_failed_count_15min"), F.col("new_device").alias("is_new_device"),
        F.col("new_location").alias("is_new_location"), "prev_us", F.col("prev_lat").alias("last_location_lat"),
        F.col("prev_lon").alias("last_location_lon"), F.col("lat").alias("current_location_lat"),
        F.col("lon").alias("current_location_lon"), F.col("prior_count").alias("total_prior_txns"),
        F.col("hour_count").alias("txns_at_this_hour"))


def score_stream(arriving: DataFrame, star: Star, rules: list[Rule] | None = None, late: str = "1 day",
                 start: DataFrame | None = None, short_min: int = VELOCITY_SHORT_MIN, long_min: int = VELOCITY_LONG_MIN,
                 failed_min: int = FAILED_WINDOW_MIN) -> DataFrame:
    """Firings of arriving transactions, from the same expressions as the batch job.

    The past of merchants and customers is state in two steps of the stream. ``start``: transactions stored before it,
    which are counted into the state of the first micro-batch. The state store must be RocksDB (``STATE_STORE``).
    """
    spark = arriving.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    of_merchants = of_customers = None
    if start is not None:
        stored = arrivals(start, star)
        late_us = spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval {late})")).first()[0]
        of_merchants = H.merchant_start(stored).withColumnRenamed("entity", "merchant_id").groupBy("merchant_id")
        began = H.customer_start(stored, late_us, max(short_min, long_min, failed_min) * US_PER_MINUTE)
        of_customers = H.dealt(began.withColumnRenamed("entity", "customer_id")).groupBy("share")
    rows = arrivals(arriving, star).withWatermark("transaction_ts", late)
    rows = rows.groupBy("merchant_id").transformWithStateInPandas(
        H.MerchantHistory(), H.MERCHANT_OUT, "Append", "EventTime", of_merchants, "transaction_ts")
    rows = H.dealt(rows).groupBy("share").transformWithStateInPandas(
        H.CustomerHistory(short_min, long_min, failed_min), H.CUSTOMER_OUT, "Append", "EventTime", of_customers, "transaction_ts")
    return apply_rules(rule_features(rows), rules)


def start_scoring(arriving: DataFrame, star: Star, firings_path: str, checkpoint: str, rules: list[Rule] | None = None,
                  **options) -> StreamingQuery:
    """Appends the firings of each micro-batch to a Parquet table, until all that has arrived is scored."""
    return (score_stream(arriving, star, rules, **options).writeStream.format("parquet").option("path", firings_path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
