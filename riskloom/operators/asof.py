"""Strict as-of join to a daily table: the latest row of an earlier day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def asof_previous_day(spine: DataFrame, daily: DataFrame, key: str, day: str, values: list[str]) -> DataFrame:
    """For each (key, day) of ``spine``: ``values`` of the last ``daily`` row with an earlier day.

    Works on day grain, so a key has at most one row per calendar day on either side; facts join
    the result by plain equality. Adds ``matched`` (some earlier row exists).
    """
    left = spine.select(key, day).distinct().select(
        key, F.col(day).alias("_day"), F.lit(None).cast(_struct_type(daily, values)).alias("_row"))
    right = daily.select(key, F.date_add(day, 1).alias("_day"), F.struct(*values).alias("_row"))
    # A daily row becomes visible one day later and sorts ahead of the spine row of that day.
    order = W.partitionBy(key).orderBy("_day", F.col("_row").isNull())
    seen = F.last("_row", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        left.unionByName(right).withColumn("_seen", seen).filter(F.col("_row").isNull())
        .select(key, F.col("_day").alias(day), F.col("_seen").isNotNull().alias("matched"),
                *[F.col(f"_seen.{v}").alias(v) for v in values])
    )


def _struct_type(df: DataFrame, values: list[str]):
    return df.select(F.struct(*values).alias("s")).schema["s"].dataType
