"""Exact global quantiles that never bring a whole column into one task."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DIRECT_ROWS = 1_000_000
BUCKETS = 1024
COLLECT_ROWS = 1_000


def _finite(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)  # NaN is above infinity


def exact_quantiles(
    df: DataFrame, columns: list[str], qs: list[float], direct_rows: int = DIRECT_ROWS,
) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of numeric columns (None for an empty column).

    Only finite numbers are ranked: nulls, NaN and infinities are ignored, on both paths.

    Up to ``direct_rows`` rows Spark's exact ``percentile`` answers in one aggregate. Beyond that its
    value map would grow with the data, so each wanted order statistic is narrowed by histograms: a
    pass counts at most ``BUCKETS`` buckets per order statistic, the bucket holding the rank becomes
    the next range, until it holds a single value or few rows.
    """
    df = df.select(*[_finite(c).alias(c) for c in dict.fromkeys(columns)])
    if df.count() <= direct_rows:
        found = df.agg(*[F.percentile(F.col(c), qs).alias(c) for c in columns]).first()
        return {c: found[c] for c in columns}
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}")
                     for c in columns for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()

    # (column, rank) -> [low, high, rank inside the range], shrinking until resolved.
    ranges: dict[tuple[str, int], list] = {}
    for c in columns:
        for q in qs if stats[f"n_{c}"] else []:
            low = int((stats[f"n_{c}"] - 1) * q)
            for rank in {low, min(low + 1, stats[f"n_{c}"] - 1)}:
                ranges[c, rank] = [stats[f"lo_{c}"], stats[f"hi_{c}"], rank]
    solved: dict[tuple[str, int], float] = {}
    while ranges:
        for target, (low, high, _) in list(ranges.items()):
            if low == high:
                solved[target] = low
                del ranges[target]
        if ranges:
            _narrow(df, ranges, solved)

    out: dict[str, list[float]] = {}
    for c in columns:
        n, row = stats[f"n_{c}"], []
        for q in qs:
            if not n:
                row.append(None)
                continue
            spot = (n - 1) * q
            low = int(spot)
            a, b = solved[c, low], solved[c, min(low + 1, n - 1)]
            row.append(a + (b - a) * (spot - low))
        out[c] = row
    return out


def _inside(df: DataFrame, ranges: Iterable[tuple[str, float, float]]) -> DataFrame:
    """Rows with a value in one of the ranges (column, low, high): after the first pass a small part of all."""
    return df.filter(reduce(or_, [F.col(c).between(low, high) for c, low, high in ranges]))


def _narrow(df: DataFrame, ranges: dict, solved: dict) -> None:
    """One histogram pass over all open ranges; shrinks or resolves each of them in place.

    Ranks in the same range share its histogram, so in the first pass a row counts once per column, not once per rank.
    """
    shared: dict[tuple[str, float, float], list] = {}
    for target, (low, high, _) in ranges.items():
        shared.setdefault((target[0], low, high), []).append(target)
    hits = []
    for i, (column, low, high) in enumerate(shared):
        value = F.col(column).cast("double")
        # Halves, so that the width of a range of very large numbers stays finite.
        bucket = F.least(F.floor((value / 2 - low / 2) / (high / 2 - low / 2) * BUCKETS), F.lit(BUCKETS - 1))
        hits.append(F.when(value.between(low, high), F.struct(
            F.lit(i).alias("range"), bucket.alias("bucket"), value.alias("value"))))
    counted = (
        _inside(df, shared).select(F.inline(F.array_compact(F.array(*hits))))
        .groupBy("range", "bucket").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        .collect()  # at most BUCKETS rows per range
    )
    small: dict[tuple[str, float, float], list] = {}
    for i, ((column, low, high), targets) in enumerate(shared.items()):
        rows = sorted((r for r in counted if r["range"] == i), key=lambda r: r["bucket"])
        for target in targets:
            rank = ranges[target][2]
            for row in rows:
                if rank < row["n"]:
                    if (row["lo"], row["hi"]) == (low, high) and row["n"] > COLLECT_ROWS:
                        raise RuntimeError(f"a histogram pass over {column} did not narrow {low}..{high}")
                    ranges[target] = [row["lo"], row["hi"], rank]
                    if row["n"] <= COLLECT_ROWS:
                        small.setdefault((column, row["lo"], row["hi"]), []).append(target)
                    break
                rank -= row["n"]
    if not small:
        return
    inside = [F.when(F.col(c).between(low, high), F.struct(F.lit(i).alias("range"), F.col(c).alias("value")))
              for i, (c, low, high) in enumerate(small)]
    values: list[list[float]] = [[] for _ in small]
    # At most COLLECT_ROWS rows per range.
    for row in _inside(df, small).select(F.inline(F.array_compact(F.array(*inside)))).collect():
        values[row["range"]].append(row["value"])
    for found, targets in zip(values, small.values()):
        found.sort()
        for target in targets:
            solved[target] = found[ranges[target][2]]
            del ranges[target]


#: Rank error of the sketch is one part in this many; the exact pass looks at four such parts around each rank.
SKETCH_ACCURACY = 10_000


def grouped_quantiles(df: DataFrame, group: str, value: str, qs: list[float], accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """``group`` and ``quantiles`` (an array, linearly interpolated, exact) of the finite numbers of each group.

    Two passes for any number of groups and quantiles. A mergeable sketch of each group gives, for every wanted rank, a
    narrow range of values that holds it. The second pass counts what lies below the range and the copies of each value inside,
    so only counts are ordered. Should a range miss its rank, that group's second pass covers all its values.
    """
    rows = df.select(F.col(group).alias("g"), _finite(value).alias("v")).filter("v is not null")
    found = _ranked(rows, _sketched(rows, qs, accuracy), qs)
    missed = found.filter("missed").select("g")
    again = rows.join(missed, "g", "left_semi")
    whole = again.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).select(
        "g", "n", F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), F.col("lo").alias("low"), F.col("hi").alias("high"))
                            for i, q in enumerate(qs)]).alias("ranges"))
    if not missed.limit(1).count():
        return found.select(F.col("g").alias(group), "quantiles")
    return (found.filter("not missed").unionByName(_ranked(again, whole, qs))).select(F.col("g").alias(group), "quantiles")


def _sketched(rows: DataFrame, qs: list[float], accuracy: int) -> DataFrame:
    """g, n and the range of values around each wanted rank."""
    margin = 2.0 / accuracy
    around = [p for q in qs for p in (max(0.0, q - margin), min(1.0, q + margin))]
    told = rows.groupBy("g").agg(F.count("*").alias("n"), F.approx_percentile("v", around, accuracy).alias("at"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # A group of few rows is ranked as a whole: a part of its ranks may be less than a row.
    few = F.col("n") <= accuracy
    return told.select("g", "n", F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(float(q)).alias("q"), F.when(few, F.col("lo")).otherwise(F.col("at")[2 * i]).alias("low"),
        F.when(few, F.col("hi")).otherwise(F.col("at")[2 * i + 1]).alias("high")) for i, q in enumerate(qs)]).alias("ranges"))


def _ranked(rows: DataFrame, ranges: DataFrame, qs: list[float]) -> DataFrame:
    """g, quantiles, and whether a rank lay outside its range."""
    each = rows.join(ranges, "g").select("g", "v", "n", F.inline("ranges")).filter("v <= high")
    counted = each.groupBy("g", "n", "i", "q", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("k"))
    along = W.partitionBy("g", "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    spot = (F.col("n") - 1) * F.col("q")
    at = counted.withColumns({"upto": F.sum("k").over(along), "rank": F.floor(spot), "part": spot - F.floor(spot)})
    first = F.col("upto") - F.col("k")
    holds = lambda rank: F.when(F.col("v").isNotNull() & (first <= rank) & (rank < F.col("upto")), F.col("v"))
    pairs = at.groupBy("g", "i").agg(
        F.max(holds(F.col("rank"))).alias("below"), F.max(holds(F.least(F.col("rank") + 1, F.col("n") - 1))).alias("above"), F.max("part").alias("part"))
    value = F.when(F.col("part") == 0, F.col("below")).otherwise(F.col("below") + (F.col("above") - F.col("below")) * F.col("part"))
    return pairs.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("x")))), lambda s: s["x"]).alias("quantiles")).withColumn(
        "missed", F.exists("quantiles", lambda x: x.isNull()) | (F.size("quantiles") < len(qs)))
