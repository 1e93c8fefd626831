"""Daily baselines joined to a transaction stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from riskloom.operators.slices import floor_div
from riskloom.plans.features import CUSTOMER_BASELINE, MERCHANT_BASELINE

#: A daily row is listed under each chunk of so many days in which it answers, so that an arriving row meets the
#: rows of one chunk and not all days of a busy merchant.
CHUNK_DAYS = 8


def _answers(daily: DataFrame, key: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Daily rows that a later row has replaced, by chunk of days; and the newest row of each key.

    A row answers for the days after its own, up to the day of the next row.
    """
    following = F.lead("metric_date").over(W.partitionBy(key).orderBy("metric_date"))
    rows = daily.select(key, "metric_date", *values).withColumn("_until", following).select(
        F.col(key).alias("_key"), F.col("metric_date").alias("_from"), "_until", F.struct(*values).alias("_row"))
    chunk = lambda day: floor_div(F.unix_date(day), CHUNK_DAYS)
    closed = rows.filter("_until is not null").withColumn(
        "_chunk", F.explode(F.sequence(chunk(F.date_add("_from", 1)), chunk(F.col("_until")))))
    return closed, rows.filter("_until is null").drop("_until")


def with_baselines(arriving: DataFrame, customers: DataFrame, merchants: DataFrame) -> DataFrame:
    """Stream-static left joins; static tables have at most one row per key and calendar day."""
    for daily, key, values in ((customers, "customer_id", CUSTOMER_BASELINE), (merchants, "merchant_id", MERCHANT_BASELINE)):
        closed, newest = _answers(daily, key, values)
        here = floor_div(F.unix_date(arriving["day"]), CHUNK_DAYS)
        on = (arriving[key] == closed["_key"]) & (here == closed["_chunk"]) & (
            (arriving["day"] > closed["_from"]) & (arriving["day"] <= closed["_until"]))
        columns = arriving.columns
        joined = arriving.join(closed, on, "left").select(*columns, F.col("_row").alias("_closed"))
        on = (joined[key] == newest["_key"]) & (joined["day"] > newest["_from"])
        joined = joined.join(newest, on, "left")
        arriving = joined.select(*columns, *[F.coalesce(f"_closed.{v}", f"_row.{v}").alias(v) for v in values])
    return arriving
