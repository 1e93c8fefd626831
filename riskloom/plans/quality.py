"""Checks a database would enforce, and the dataset profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.sources.star import Star

MAX_AMOUNT = 100_000  # fixed value


def _orphans(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose key is missing in the dimension (pre-counted per key before the join)."""
    per_key = facts.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.join(dim.select(key), key, "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations"))


def quality_checks(star: Star) -> DataFrame:
    """One row per check: name and number of violations (0 = passed)."""
    txn = star.txn
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(True)))
    ids = txn.groupBy("transaction_id").agg(F.count("*").alias("n")).agg(
        F.sum(F.col("n") - 1).alias("duplicate_ids"),
        (F.max("transaction_id") - F.min("transaction_id") + 1 - F.count("*")).alias("gaps_in_ids"))
    rows = txn.agg(
        count(F.length("payment_instrument_last4") != 4).alias("last4_length"),
        count(F.col("amount") <= 0).alias("amount_not_positive"),
        count(F.col("amount") >= MAX_AMOUNT).alias("amount_out_of_bounds"))
    labels = star.labels.agg(
        F.count_if(~F.col("is_fraud") & F.col("fraud_typology").isNotNull()).alias("typology_without_fraud"),
        count(~F.col("is_synthetic_label")).alias("label_not_synthetic"))
    out = None
    for wide in (ids, rows, labels):
        pairs = F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).cast("long").alias("violations")) for c in wide.columns])
        part = wide.select(F.inline(pairs))
        out = part if out is None else out.unionByName(part)
    for name, dim, key in (("customer", star.customer, "customer_id"), ("merchant", star.merchant, "merchant_id"),
                           ("device", star.device, "device_id"), ("location", star.location, "location_id")):
        part = _orphans(txn, dim, key).select(F.lit(f"unknown_{name}").alias("check_name"), "violations")
        out = out.unionByName(part)
    return out


def dataset_profile(star: Star) -> DataFrame:
    """Entity counts, fraud rate and date range in one row."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    facts = star.txn.agg(F.count("*").alias("transactions"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    frauds = star.labels.agg(F.count_if("is_fraud").alias("fraud_transactions"))
    return (
        one(star.customer, "customers").crossJoin(one(star.merchant, "merchants"))
        .crossJoin(one(star.device, "devices")).crossJoin(one(star.location, "locations"))
        .crossJoin(facts).crossJoin(frauds)
        .withColumn("fraud_rate", F.coalesce(F.round(F.try_divide("fraud_transactions", "transactions"), 4), F.lit(0.0)))
    )


def typology_counts(star: Star) -> DataFrame:
    return star.labels.filter("is_fraud").groupBy("fraud_typology").agg(F.count("*").alias("n"))
