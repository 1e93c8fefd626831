"""Time slices: how per-entity windows stay bounded when one entity holds most of the rows.

A window over ``partitionBy(entity)`` puts an entity into one task. Here the timeline of an entity with more
than ``max_rows`` rows is cut into slices, each slice is its own window partition, and what a slice must know
about the past arrives as one *carry row* made from per-slice totals. Entities whose busiest slice exceeds
``max_rows`` get finer slices, by a power of two. All other entities are one slice; the computation is the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.session import cut_lineage

US_PER_SECOND = 1_000_000
US_PER_MINUTE = 60 * US_PER_SECOND
US_PER_HOUR = 60 * US_PER_MINUTE
US_PER_DAY = 24 * US_PER_HOUR

MAX_SLICE_ROWS = 2_000_000
# 2**13 divides a day in micros exactly, so a split slice never straddles midnight.
MAX_SPLIT = 8192
# A split entity has more than MAX_SLICE_ROWS rows, so this table has at most rows/MAX_SLICE_ROWS
# entries; beyond this many it is joined without a broadcast hint.
MAX_BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class Slicing:
    """How one entity key is cut: base width, and the split factor of the listed entities (if any).

    With ``whole`` an entity that is not listed is one slice, number 0; otherwise it has slices of the base width.
    """

    key: str
    width_us: int
    splits: DataFrame | None = None
    broadcast: bool = True
    rows: int = 0
    whole: bool = False

    def add(self, df: DataFrame, at: str = "ts_us") -> DataFrame:
        """Adds ``split``, ``slice_us`` (width) and ``slice_no`` for the time column ``at``.

        One slice for all time has no ``split`` and no ``slice_us``.
        """
        if self.splits is None:
            df = df.withColumn("split", F.lit(None if self.whole else 1).cast("int"))
        else:
            splits = F.broadcast(self.splits) if self.broadcast else self.splits
            df = df.join(splits, self.key, "left")
            if not self.whole:
                df = df.withColumn("split", F.coalesce("split", F.lit(1)))
        width = (F.lit(self.width_us) / F.col("split")).cast("long")
        return df.withColumn("slice_us", width).withColumn(
            "slice_no", F.coalesce(floor_div(F.col(at), F.col("slice_us")), F.lit(0).cast("long")))


def floor_div(value: Column, width: Column | int) -> Column:
    """Integer floor division, right for negative values too."""
    width = F.lit(width) if isinstance(width, int) else width
    return ((value - F.pmod(value, width)) / width).cast("long")


def floor_sql(value: str, width: int | str) -> str:
    """SQL of the same floor division."""
    return f"(({value}) - pmod({value}, {width})) div {width}"


def plan_slices(df: DataFrame, key: str, width_us: int, max_rows: int = MAX_SLICE_ROWS, whole: bool = False) -> Slicing:
    """Lists the entities to cut, by one grouped count where the total leaves room for one.

    Those are entities with an overfull slice, or, with ``whole``, with more than ``max_rows`` rows altogether. The
    list is written once; it has at most rows / max_rows entries.
    """
    rows = df.count()
    if rows <= max_rows:
        return Slicing(key, width_us, rows=rows, whole=whole)
    per_slice = df.groupBy(key, floor_div(F.col("ts_us"), width_us).alias("_slice")).count()
    needed = F.greatest(F.lit(0), F.ceil(F.log2(F.max("count") / F.lit(max_rows))))
    per_key = per_slice.groupBy(key).agg(F.sum("count").alias("_rows"), F.pow(F.lit(2), needed).cast("int").alias("split"))
    listed = cut_lineage(per_key.filter(F.col("_rows") > max_rows if whole else F.col("split") > 1).select(key, "split"))
    found = listed.agg(F.count("*").alias("n"), F.max("split").alias("split")).first()
    if not found["n"]:
        return Slicing(key, width_us, rows=rows, whole=whole)
    if found["split"] > MAX_SPLIT:
        raise ValueError(f"one {key} has over {max_rows * MAX_SPLIT} rows in a slice: raise max_rows")
    return Slicing(key, width_us, listed, found["n"] <= MAX_BROADCAST_KEYS, rows, whole)
