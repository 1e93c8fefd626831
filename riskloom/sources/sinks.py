"""Parquet sinks: full refresh, keyed upsert by day, append-only logs, run reports."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.operators.spans import in_spans
from riskloom.session import cut_lineage


def full_refresh(df: DataFrame, path: str, sort_by: list[str] | None = None) -> None:
    """Replace the whole table. Sorting inside files gives min/max pruning on the key."""
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.option(
        "partitionOverwriteMode", "static").mode("overwrite").parquet(path)


KEY_BITS = 16


def space_filling_key(df: DataFrame, columns: list[str], bits: int = KEY_BITS) -> Column:
    """Bits of the columns' places in their own ranges, interleaved: rows near in all columns have keys near each other."""
    values = {c: F.col(c).cast("double") for c in columns}
    ends = df.agg(*[f(v).alias(f"{n}_{c}") for c, v in values.items() for n, f in (("low", F.min), ("high", F.max))]).first()
    out = F.lit(0).cast("long")
    for i, (c, value) in enumerate(values.items()):
        low, high = ends[f"low_{c}"] or 0.0, ends[f"high_{c}"] or 0.0
        place = F.coalesce(F.floor((value - low) / max(high - low, 1.0) * ((1 << bits) - 1)), F.lit(0)).cast("long")
        for b in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(place, b).bitwiseAND(F.lit(1)), b * len(columns) + i))
    return out


def clustered_refresh(df: DataFrame, path: str, near: list[str], ids: list[str], files: int | None = None, row_group_bytes: int | None = None) -> None:
    """Replace the whole table, clustered: rows range-partitioned and sorted by a space-filling key of ``near``.

    Files and row groups then hold small ranges of each of these columns, so a filter on any of them skips most by minimum and
    maximum. Columns of ``ids`` get Parquet bloom filters, which skip for equality with an id that no range can tell.
    """
    rows = df.withColumn("_key", space_filling_key(df, near))
    order = ["_key", *near]
    rows = (rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)).sortWithinPartitions(*order).drop("_key")
    writer = rows.write.option("partitionOverwriteMode", "static").mode("overwrite")
    for c in ids:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)


def upsert_days(df: DataFrame, path: str, day: str = "metric_date") -> None:
    """Idempotent day-grain upsert: every day present in ``df`` replaces that day's partition.

    ``df`` must hold the whole content of the days it names, which daily rollups do. Rows are rebalanced by day first,
    so that a day has few files (a large day several), sorted by their first column.
    """
    key = next(c for c in df.columns if c != day)
    df.hint("rebalance", F.col(day)).sortWithinPartitions(day, key).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(day).parquet(path)


def upsert_rows(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed upsert as a frame: changed keys replace current rows, others stay."""
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def replace_keys_of_days(rows: DataFrame, replaced: DataFrame, path: str, key: str, day: str = "metric_date") -> list:
    """Replace the rows of the given key and spans of days in a table stored by day; returns the days that were written.

    Only the partitions of days on which a row comes or goes are read and rewritten; their other rows are carried over.
    """
    spark = rows.sparkSession
    rows = cut_lineage(rows)
    stored = spark.read.parquet(path)
    gone = in_spans(stored.select(key, day), replaced, key, day).select(day)
    days = sorted(r[0] for r in gone.unionByName(rows.select(day)).distinct().collect())  # at most one per calendar day
    if not days:
        return []
    kept = in_spans(stored.filter(F.col(day).isin(days)), replaced, key, day, inside=False)
    # Written aside first: a partition cannot be read and overwritten in one job.
    upsert_days(cut_lineage(kept.unionByName(rows.select(*stored.columns))), path, day)
    return days


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_new(df: DataFrame, stored: DataFrame | None, path: str, keys: list[str]) -> None:
    """Append the rows whose key is not stored yet, so that a re-run changes nothing."""
    append_log(df if stored is None else df.join(stored.select(*keys), keys, "left_anti").select(*df.columns), path)


def write_report(df: DataFrame, path: str) -> None:
    """Small run report as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def refresh_baselines(
    spark: SparkSession, customer_daily: Callable[[], DataFrame], merchant_daily: Callable[[], DataFrame],
    root: str,
) -> DataFrame:
    """Writes both daily baseline tables and returns a one-row report with counts and seconds."""
    started = time.monotonic()
    counts = {}
    for name, build in (("customer", customer_daily), ("merchant", merchant_daily)):
        path = f"{root}/fact_{name}_daily_metrics"
        upsert_days(build(), path)
        counts[name] = spark.read.parquet(path).count()
    elapsed = time.monotonic() - started
    return spark.range(1).select(
        F.lit(counts["customer"]).cast("long").alias("customer_rows"),
        F.lit(counts["merchant"]).cast("long").alias("merchant_rows"),
        F.lit(elapsed).alias("elapsed_seconds"),
    )
