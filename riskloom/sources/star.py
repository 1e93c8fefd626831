"""Reading the star schema from parquet, and the scoring scan derived from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.schema import TABLES


@dataclass(frozen=True)
class Star:
    """The base tables as lazily read frames."""

    txn: DataFrame
    customer: DataFrame
    merchant: DataFrame
    location: DataFrame
    device: DataFrame
    labels: DataFrame


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Parquet scan with the declared schema (no inference pass)."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_star(spark: SparkSession, root: str) -> Star:
    return Star(
        txn=with_time_parts(read_table(spark, root, "fact_transactions")),
        customer=read_table(spark, root, "dim_customer"),
        merchant=read_table(spark, root, "dim_merchant"),
        location=read_table(spark, root, "dim_location"),
        device=read_table(spark, root, "dim_device"),
        labels=read_table(spark, root, "ground_truth_fraud"),
    )


def with_time_parts(txn: DataFrame) -> DataFrame:
    """Adds ``ts_us`` (epoch micros), ``day`` and ``hour``, all in UTC."""
    return (
        txn.withColumn("ts_us", F.unix_micros("transaction_ts"))
        .withColumn("day", F.to_date("transaction_ts"))
        .withColumn("hour", F.hour("transaction_ts").cast("long"))
    )


def located(star: Star, txn: DataFrame | None = None) -> DataFrame:
    """Transactions inner-joined to their location; rows with no known location drop out.

    The location dimension is small, but no broadcast is forced: Spark picks it by size.
    """
    loc = star.location.select(
        "location_id",
        F.col("latitude").cast("double").alias("current_location_lat"),
        F.col("longitude").cast("double").alias("current_location_lon"),
    )
    return (txn if txn is not None else star.txn).join(loc, "location_id")


def location_scan_report(star: Star) -> DataFrame:
    """How many rows the location join keeps and drops."""
    loc = star.location.select("location_id", F.lit(True).alias("known"))
    return star.txn.join(loc, "location_id", "left").agg(
        F.count("*").alias("rows_read"),
        F.count_if("known").alias("rows_kept"),
        F.count_if(F.col("known").isNull()).alias("rows_dropped"),
    )


def labelled(txn: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join to labels; a missing label means not fraud."""
    found = labels.select("transaction_id", F.col("is_fraud").alias("_fraud"))
    return txn.join(found, "transaction_id", "left").withColumn(
        "is_fraud", F.coalesce("_fraud", F.lit(False))).drop("_fraud")
