"""Gap sessions per entity, cut into day slices so that a hot entity spreads over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from riskloom.operators.slices import Slicing


def gap_sessions(df: DataFrame, slicing: Slicing, gap_us: int, tie: str = "transaction_id") -> DataFrame:
    """Adds ``session_start`` (struct ts_us, id): the first row of the row's session.

    A session goes on while the step from the entity's previous row is at most ``gap_us``.
    """
    key = slicing.key
    cell = W.partitionBy(key, "slice_no").orderBy("ts_us", tie)
    here = F.struct(F.col("ts_us"), F.col(tie).alias("id"))
    rows = slicing.add(df).drop("split", "slice_us")
    rows = rows.withColumn("_break", F.when(F.col("ts_us") - F.lag("ts_us").over(cell) > gap_us, here))

    # What each slice passes on: its first row, last time, and the start of its last own session.
    cells = rows.groupBy(key, "slice_no").agg(
        F.min(here).alias("first"), F.max("ts_us").alias("last_us"), F.max("_break").alias("last_break"))
    along = W.partitionBy(key).orderBy("slice_no")
    reaches_back = F.col("first.ts_us") - F.lag("last_us").over(along) <= gap_us
    cells = cells.withColumn("opens", F.when(~F.coalesce(reaches_back, F.lit(False)), F.col("first")))
    passed_on = F.coalesce("last_break", "opens")
    carried = F.last(passed_on, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select(key, "slice_no", F.coalesce("opens", carried).alias("_cell_start"))

    own_start = F.last("_break", ignorenulls=True).over(cell.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("_own_start", own_start)
    return (
        rows.join(cells, [key, "slice_no"])
        .withColumn("session_start", F.coalesce("_own_start", "_cell_start"))
        .drop("_break", "_own_start", "_cell_start", "slice_no")
    )
