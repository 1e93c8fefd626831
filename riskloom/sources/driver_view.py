"""Deterministic view of the driver's general tables as the star schema.

``events`` becomes the fact table; ``customer``, ``part`` and ``nation`` become the dimensions.
Only arithmetic on the given columns is used, so the SQL oracles can state the same view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.sources.star import Star, with_time_parts


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_of(_read(spark, sf_dir, "events"))


def transactions_of(events: DataFrame) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    at_home = eid % 10 < 8
    txn = events.select(
        eid.alias("transaction_id"),
        F.concat(F.lit("TXN-"), eid.cast("string")).alias("transaction_uid"),
        uid.alias("customer_id"),
        F.get_json_object("props", "$.k").cast("long").alias("merchant_id"),
        (uid * 4 + F.when(at_home, F.lit(0)).otherwise(eid % 4)).alias("device_id"),
        F.when(at_home, uid % 25).otherwise(eid % 25).cast("long").alias("location_id"),
        F.col("ts").cast("timestamp").alias("transaction_ts"),
        F.col("value").cast("decimal(14,2)").alias("amount"),
        F.lit("USD").alias("currency"),
        F.when(eid % 5 == 0, "ECOM").when(eid % 5 == 1, "POS").when(eid % 5 == 2, "ATM")
        .when(eid % 5 == 3, "WALLET").otherwise("CARD_PRESENT").alias("channel"),
        F.lpad((eid % 10000).cast("string"), 4, "0").alias("payment_instrument_last4"),
        F.when(F.col("event_type") == "error", "FAILED")
        .when(F.col("event_type") == "signup", "DECLINED").otherwise("APPROVED").alias("status"),
    )
    return with_time_parts(txn)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id")
    fraud = ((F.col("value") >= 200) & (eid % 3 == 0)) | (eid % 97 == 0)
    typology = F.when(F.col("value") >= 200, "HIGH_VALUE").otherwise("PROBE")
    return _read(spark, sf_dir, "events").select(
        eid.alias("transaction_id"),
        fraud.alias("is_fraud"),
        F.when(fraud, typology).alias("fraud_typology"),
        F.lit(True).alias("is_synthetic_label"),
    )


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second, sparse series (years, day granularity) from ``orders``."""
    txn = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        (F.col("o_orderkey") % 50).alias("merchant_id"),
        (F.col("o_custkey") * 4 + F.col("o_orderkey") % 3).alias("device_id"),
        F.col("o_orderdate").cast("timestamp").alias("transaction_ts"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("amount"),
    )
    return with_time_parts(txn)


def star_from_driver_tables(spark: SparkSession, sf_dir: str) -> Star:
    txn = transactions(spark, sf_dir)
    location = _read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("location_id"),
        F.col("n_name").alias("city"),
        F.lit("ZZ").alias("country"),
        (F.lit(-60) + 5 * F.col("n_nationkey")).cast("decimal(9,6)").alias("latitude"),
        (F.lit(-170) + 14 * F.col("n_nationkey")).cast("decimal(9,6)").alias("longitude"),
    )
    key = F.col("c_custkey")
    customer = _read(spark, sf_dir, "customer").select(
        key.alias("customer_id"),
        F.col("c_name").alias("customer_uid"),
        F.col("c_nationkey").cast("string").alias("home_city"),
        F.lit("ZZ").alias("home_country"),
        F.when(key % 20 == 0, "WATCHLIST").when(key % 20 == 1, "VIP").otherwise("STANDARD").alias("risk_segment"),
    )
    part = F.col("p_partkey")
    merchant = _read(spark, sf_dir, "part").select(
        part.alias("merchant_id"),
        F.col("p_name").alias("merchant_name"),
        F.col("p_type").alias("mcc_description"),
        F.when(part % 12 == 0, "HIGH_RISK").otherwise("STANDARD").alias("risk_category"),
    )
    device = txn.select("device_id").distinct()
    return Star(txn, customer, merchant, location, device, labels(spark, sf_dir))
