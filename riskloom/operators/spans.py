"""Spans of days per entity: what changed days touch, as one row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def window_spans(changed: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """(key, spans): the days from ``before`` days before a changed day to ``after`` days behind it, one row per key.

    Overlapping windows are one span (first, last), so a key has at most one span for each ``before + after + 1`` days.
    """
    none = F.array().cast("array<struct<first:int,last:int>>")
    span = lambda d: F.struct((d - before).alias("first"), (d + after).alias("last"))

    def joined(spans: Column, d: Column) -> Column:
        held = F.element_at(spans, -1)
        longer = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(held["first"].alias("first"), (d + after).alias("last"))))
        return F.when((F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["last"] + 1 >= d - before), longer).otherwise(F.concat(spans, F.array(span(d))))

    days = changed.filter(F.col(key).isNotNull() & F.col("day").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.unix_date("day"))).alias("days"))
    return days.select(key, F.aggregate("days", none, joined).alias("spans"))


def in_spans(df: DataFrame, spans: DataFrame, key: str, day: str, inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose day is in a span of their key, or with ``inside=False`` the others."""
    at = F.unix_date(F.col(day))
    found = F.coalesce(F.exists("spans", lambda s: at.between(s["first"], s["last"])), F.lit(False))
    # The spans grow with the entities: this join must not broadcast, also where they compress well.
    both = df.join(spans.hint("merge"), key, "inner" if inside else "left")
    return both.filter(found if inside else ~found).select(*df.columns)
