"""Shards of near-equal bytes by k-d tree partitioning, in DataFrame expressions only.

Documents with equal texts form a group and stay together. Groups are points of metadata dimensions, weighted by
their bytes. A node is split along its widest dimension (range over the range of all groups) at the weighted
quantile that matches the leaves on either side, until each leaf is one shard. Quantiles are found by
distributed histograms that narrow down on the cut: the driver sees ``BUCKETS`` sums per node and pass, never rows.

A group that alone weighs more than a hundredth of a shard would make cuts uneven. There are at most 100 * shards of
them; they are placed first, largest first on the emptiest shard, and the tree gives each shard what is left to fill.

A null text has size 1, no crc, and counts as equal to other null texts. Ties are broken by hash of the text.
Repeated rows keep a slot each. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

BUCKETS = 4096
HEAVY_SHARE = 100
SLOT_ROWS = 4096
#: A split key is 30 bits of position and 31 bits of hash.
TIE = 1 << 31
TOP = 1 << 30


def placed(loads: list[float], light: float) -> list[float]:
    """What each shard still takes, so that all end as equal as their loads allow."""
    low, high = min(loads), max(loads) + light
    for _ in range(200):
        mid = (low + high) / 2
        if sum(max(0.0, mid - x) for x in loads) < light:
            low = mid
        else:
            high = mid
    return [max(0.0, high - x) for x in loads]


def _case(values: dict[int, object], node: str = "node") -> str:
    return f"CASE {node} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"


def tree(points: DataFrame, dims: list[str], capacity: list[float]) -> DataFrame:
    """Give every point (group, weight, dims in 0..1) its leaf; leaf i takes about the share capacity[i] of the weight."""
    nodes = {0: (0, len(capacity))}  # node: its leaves, first to last
    points = points.withColumn("node", F.lit(0))
    while any(b - a > 1 for a, b in nodes.values()):
        stats = points.groupBy("node").agg(
            F.sum("weight").alias("weight"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims])
        split, keys = {}, {}
        for r in stats.collect():
            a, b = nodes[r["node"]]
            if b - a > 1:
                dim = max(dims, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"], -dims.index(d)))
                middle = (a + b) // 2
                whole = sum(capacity[a:b])
                share = sum(capacity[a:middle]) / whole if whole else 0.5
                split[r["node"]] = {"lo": 0, "hi": TOP * TIE, "want": r["weight"] * share, "below": 0.0, "weight": r["weight"]}
                keys[r["node"]] = f"cast(least(floor({dim} * {TOP}), {TOP - 1}) as bigint) * {TIE} + pmod(group, {TIE})"
        keyed = points.withColumn("key", F.expr(_case(keys)) if keys else F.lit(None).cast("long"))
        cuts = {}
        while split:
            width = {n: max(1, -(-(s["hi"] - s["lo"]) // BUCKETS)) for n, s in split.items()}
            bucket = f"(key - {_case({n: s['lo'] for n, s in split.items()})}) div {_case(width)}"
            inside = f"key >= {_case({n: s['lo'] for n, s in split.items()})} AND key < {_case({n: s['hi'] for n, s in split.items()})}"
            rows = (keyed.filter(inside).groupBy("node", F.expr(bucket).alias("bucket"))
                    .agg(F.sum("weight").alias("weight")).collect())
            for n, s in list(split.items()):
                sums = sorted((r["bucket"], r["weight"]) for r in rows if r["node"] == n)
                for i, w in sums:
                    if s["below"] + w > s["want"] or i == sums[-1][0]:
                        s["hi"] = min(s["hi"], s["lo"] + (i + 1) * width[n])
                        s["lo"] = s["lo"] + i * width[n]
                        near = w
                        break
                    s["below"] += w
                else:
                    near = 0
                if s["hi"] - s["lo"] <= 1 or near <= s["weight"] * 1e-4 or not sums:
                    # The cut goes to the nearer end of the last bucket.
                    cuts[n] = s["lo"] if s["want"] - s["below"] <= near / 2 else s["hi"]
                    del split[n]
        children, new = {}, {}
        for n, (a, b) in nodes.items():
            if n in cuts:
                middle = (a + b) // 2
                new[2 * n + 1], new[2 * n + 2] = (a, middle), (middle, b)
                children[n] = f"CASE WHEN key < {cuts[n]} THEN {2 * n + 1} ELSE {2 * n + 2} END"
            elif b - a > 1:  # a node without points
                children[n] = str(n)
                new[n] = (a, a + 1)
            else:
                children[n], new[n] = str(n), (a, b)
        points = cut_lineage(keyed.withColumn("node", F.expr(_case(children))).drop("key"))
        nodes = new
    return points.withColumn("shard", F.expr(_case({n: a for n, (a, _) in nodes.items()}))).drop("node")


def assign(df: DataFrame, id_column: str, text: str, dimensions: dict[str, Column], shards: int | None = None,
           target_bytes: int | None = None) -> DataFrame:
    """Shard of every row: doc_id, size, text_crc32, shard, slot (gapless from 0 within a shard).

    ``dimensions`` are numeric metadata of a row; a group has its least value, nulls count as the least of all.
    Give the number of shards, or the bytes a shard should hold.
    """
    own = F.col(text)
    rows = df.select(
        F.col(id_column).alias("doc_id"), (F.coalesce(F.octet_length(own), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(own.cast("binary")).alias("text_crc32"), F.xxhash64(own).alias("group"),
        *[c.cast("double").alias(f"d_{n}") for n, c in dimensions.items()])
    rows = cut_lineage(rows)
    dims = [f"d_{n}" for n in dimensions]
    total = rows.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), *[F.min(d).alias(f"lo_{d}") for d in dims],
                     *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    weight, count = total["w"] or 0, total["n"]
    shards = shards or max(1, math.ceil(weight / (target_bytes or 1 << 30)))
    scaled = []
    for d in dims:
        lo, hi = total[f"lo_{d}"], total[f"hi_{d}"]
        wide = hi is not None and hi > lo
        scaled.append(F.coalesce((F.col(d) - lo) / (hi - lo), F.lit(0.0)).alias(d) if wide else F.lit(0.0).alias(d))
    groups = cut_lineage(rows.groupBy("group").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"),
                                                   *[F.min(d).alias(d) for d in dims])
                         .select("group", "weight", "n", *scaled))
    heavy = ((F.col("weight") * shards * HEAVY_SHARE > weight) | (F.col("n") * shards * HEAVY_SHARE > count))
    first = groups.filter(heavy).select("group", "weight").orderBy(F.desc("weight"), "group").collect()
    loads, where = [0.0] * shards, {}
    for r in first:
        emptiest = loads.index(min(loads))
        loads[emptiest] += r["weight"]
        where[r["group"]] = emptiest
    light = tree(groups.filter(~heavy).select("group", "weight", *dims), dims, placed(loads, weight - sum(loads)))
    narrow = rows.select("doc_id", "size", "text_crc32", "group")
    listed = ", ".join(f"({g}L, {s})" for g, s in where.items()) or "(0L, -1)"
    # At most 200 * shards rows.
    known = F.broadcast(df.sparkSession.sql(f"SELECT * FROM VALUES {listed} AS t(group, shard) WHERE shard >= 0"))
    out = (narrow.join(known, "group").unionByName(
        narrow.join(known, "group", "left_anti").join(light.select("group", "shard"), "group")))
    return slots(out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard")), count, shards)


def slots(df: DataFrame, count: int, shards: int) -> DataFrame:
    """Number the rows of each shard from 0 without gaps: in hash buckets, behind the counts of the buckets before."""
    parts = max(1, math.ceil(count / shards / SLOT_ROWS))
    rows = df.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("own", F.row_number().over(order) - 1)
    return numbered.join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"))
