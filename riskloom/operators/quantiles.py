"""Exact trailing quantiles per entity, as of the previous row.

For every row: q1, median, q3 and count of the amounts in (t_prev - W, t_prev], t_prev being the
entity's previous row. The entity's time is cut into chunks of W/k (k = 1 unless the entity is hot).
The chunk ``c`` of a window needs the rows of chunk ``c`` itself, the rows of chunk ``c - k`` (they
leave the window while ``c`` runs) and, for k > 1, the *value counts* of the chunks between. So a
row is copied twice however long the window is, and the counts are pre-aggregated by value; no task
sees more than two chunks of rows plus one histogram. Chunks far shorter than the histogram would only multiply
its copies, so k is bounded by the repeats of values. Amounts are whole cents. Inside a chunk all windows
are pieces of one sequence, and a static structure answers them by array operations.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from riskloom.operators.slices import Slicing, floor_div
from riskloom.session import cut_lineage

OWN, LEAVING, STANDING, HANDOVER = 0, 1, 2, 3

GROUP_ROWS = 20_000
#: Copies of standing values that chunks may add up to, per row.
STANDING_SHARE = 2

_OUT = "transaction_id long, q1 double, median double, q3 double, prior_count long"


def trailing_quantiles_asof(txn: DataFrame, slicing: Slicing) -> DataFrame:
    """(transaction_id, q1, median, q3, prior_count); an entity's first row has no output row."""
    key = slicing.key
    rows = txn.select(key, "transaction_id", "ts_us", (F.col("amount") * 100).cast("long").alias("cents"))
    slicing = affordable(rows, slicing)
    rows = slicing.add(rows)
    cells = rows.selectExpr(
        key, "transaction_id", "ts_us", "cents", "cast(split as long) as split",
        f"inline(array(struct(slice_no as chunk, {OWN} as role), struct(slice_no + split as chunk, {LEAVING} as role)))",
    ).withColumn("n", F.lit(1).cast("long"))

    # The last row of a chunk hands its state to the first row of the entity's next chunk.
    firsts = rows.groupBy(key, "slice_no").agg(F.min(F.struct("ts_us", "transaction_id")).alias("f"))
    handover = firsts.select(
        key, F.col("slice_no").alias("chunk"), F.lit(HANDOVER).alias("role"),
        F.lead("f.transaction_id").over(W.partitionBy(key).orderBy("slice_no")).alias("transaction_id"),
    ).filter("transaction_id is not null")
    parts = cells.unionByName(handover, allowMissingColumns=True)

    if slicing.splits is not None:
        standing = _standing_counts(rows, key).withColumn("role", F.lit(STANDING))
        parts = parts.unionByName(standing, allowMissingColumns=True)

    # Entities share a Python call by hash, about GROUP_ROWS rows at a time: a call per entity would
    # cost more than its rows. An entity's chunk is bounded by the slicing, so a call is too. The
    # stage is Python-bound: it keeps all partitions instead of letting AQE coalesce them by bytes.
    pieces = int(txn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(pieces, slicing.rows // GROUP_ROWS)
    parts = parts.select(
        F.pmod(F.xxhash64(key), F.lit(groups)).alias("cell"), F.col(key).alias("entity"), "chunk", "role",
        "transaction_id", "ts_us", "cents", "n").repartition(pieces, "cell", "chunk")
    return parts.groupBy("cell", "chunk").applyInArrow(_cell_quantiles(slicing.width_us), _OUT)


def affordable(rows: DataFrame, slicing: Slicing) -> Slicing:
    """``slicing`` with at most so many chunks a window that the standing values stay a multiple of the rows.

    A chunk holds the distinct values of its window whatever its length, so with d of them among n rows k chunks make
    k * d copies. More than ``STANDING_SHARE`` * n / d chunks are not made: such a chunk's own rows are no more than the
    values that it holds anyway. Entities whose values repeat are cut as finely as ``slicing`` says.
    """
    if slicing.splits is None:
        return slicing
    key = slicing.key
    splits = F.broadcast(slicing.splits) if slicing.broadcast else slicing.splits
    values = rows.join(splits, key).groupBy(key, "split", floor_div(F.col("ts_us"), slicing.width_us).alias("_slice"), "cents").agg(
        F.count("*").alias("n"))
    # The busiest window decides, so that none of them has longer chunks than its own values ask for.
    windows = values.groupBy(key, "split", "_slice").agg((F.sum("n") / F.count("*")).alias("repeats"))
    finest = F.pow(F.lit(2), F.floor(F.log2(STANDING_SHARE * F.max("repeats"))))
    bounded = windows.groupBy(key, "split").agg(finest.alias("finest")).select(key, F.least("split", "finest").cast("int").alias("split"))
    return replace(slicing, splits=cut_lineage(bounded))


def _standing_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, chunk, cents, n): copies of each value that stay in the window all through the chunk.

    Rows of slice s stand in chunks s+1 .. s+k-1. Per value that is a step function of the chunk, so
    it is summed from its +n/-n steps and only then spread over the chunks between two steps: the
    output is one row per chunk and standing value, never one per row and chunk.
    """
    per_slice = rows.filter("split > 1").groupBy(key, "slice_no", "split", "cents").agg(F.count("*").alias("n"))
    steps = (
        per_slice.selectExpr(key, "cents", "inline(array(struct(slice_no + 1 as chunk, n as step), "
                             "struct(slice_no + split as chunk, -n as step)))")
        .groupBy(key, "cents", "chunk").agg(F.sum("step").alias("step"))
    )
    along = W.partitionBy(key, "cents").orderBy("chunk")  # at most two rows per slice of the entity
    spans = steps.select(
        key, "cents", "chunk", F.sum("step").over(along).alias("n"), (F.lead("chunk").over(along) - 1).alias("_last"))
    return spans.filter("n > 0").select(key, "cents", "n", F.explode(F.sequence("chunk", "_last")).alias("chunk"))


class RangeRanks:
    """Order statistics of any contiguous piece of a sequence: a wavelet matrix over rank-compressed values.

    One level per bit of the compressed value holds how many elements before each place have a 0 there; elements are then
    stably dealt by that bit for the next level. A query narrows its piece level by level, and whole arrays of queries
    do so at once. ``extra``: copies of values (sorted, distinct) that belong to every piece.
    """

    def __init__(self, values: np.ndarray, extra: tuple[np.ndarray, np.ndarray] | None = None):
        more, copies = extra or (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.domain, code = np.unique(np.concatenate((values, more)), return_inverse=True)
        code = code.astype(np.int32)
        self.bits = max(1, int(len(self.domain) - 1).bit_length())
        self.held = None
        if len(more):
            counts = np.zeros((1 << self.bits) + 1, np.int64)
            counts[code[len(values):] + 1] = copies
            self.held = np.cumsum(counts)
        own = code[: len(values)]
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            one = (own >> bit) & 1
            before = np.zeros(len(own) + 1, np.int32)
            np.cumsum(1 - one, out=before[1:])
            self.zeros.append(before)
            one = one.astype(bool)
            own = np.concatenate((own[~one], own[one]))

    def at_rank(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The ``rank``-th smallest (from 0) of the pieces [left, right) and the extra values."""
        left, right, rank = left.astype(np.int32), right.astype(np.int32), rank.astype(np.int64)
        code = np.zeros(len(rank), np.int32)
        for bit, before in zip(range(self.bits - 1, -1, -1), self.zeros):
            a, b = before[left], before[right]
            low = (b - a).astype(np.int64)
            if self.held is not None:
                low += self.held[code + (1 << bit)] - self.held[code]
            up = rank >= low
            rank -= np.where(up, low, 0)
            left, right = np.where(up, before[-1] + left - a, a), np.where(up, before[-1] + right - b, b)
            code |= up.astype(np.int32) << bit
        return self.domain[code]


QUARTILES = np.array([0.25, 0.5, 0.75])


def _quartiles(ranks: RangeRanks, left: np.ndarray, right: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Quartiles of each piece, interpolated between neighbouring order statistics, in currency units."""
    spot = (total[:, None] - 1) * QUARTILES
    low = spot.astype(np.int64)
    rank = np.concatenate((low, np.minimum(low + 1, total[:, None] - 1)), axis=1)
    found = ranks.at_rank(np.repeat(left, 6), np.repeat(right, 6), rank.ravel()).reshape(-1, 6)
    below, above = found[:, :3], found[:, 3:]
    return (below + (above - below) * (spot - low)) / 100.0


def _cell_quantiles(window_us: int):
    """Handles all entities of a (hash cell, chunk) group at once; those with standing values one by one."""
    def one_cell(cell: pa.Table) -> pa.Table:
        entity, role, ids, ts, cents, n = (cell.column(c).fill_null(0).to_numpy() for c in ("entity", "role", "transaction_id", "ts_us", "cents", "n"))
        hot = np.unique(entity[role == STANDING])
        shared = ~np.isin(entity, hot)
        parts = [_group(window_us, *(x[shared] for x in (entity, role, ids, ts, cents)))]
        for one in hot.tolist():
            own, stands = (entity == one) & (role != STANDING), (entity == one) & (role == STANDING)
            value, at = np.unique(cents[stands], return_inverse=True)
            parts.append(_group(window_us, *(x[own] for x in (entity, role, ids, ts, cents)),
                                extra=(value, np.bincount(at, n[stands]).astype(np.int64))))
        receiver, found, total = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return pa.table([pa.array(receiver), *(pa.array(found[:, i]) for i in range(3)), pa.array(total)],
                        names=["transaction_id", "q1", "median", "q3", "prior_count"])

    return one_cell


def _group(window_us: int, entity: np.ndarray, role: np.ndarray, ids: np.ndarray, ts: np.ndarray, cents: np.ndarray,
           extra: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Receiving row, quartiles and count after each own row of the entities of a chunk.

    With an entity's leaving rows before its own ones, both in time order, every window is a contiguous piece: a chunk is
    at most one window long, so its own rows never leave inside it. The state after a row belongs to the row that
    follows, in this chunk or (handed over) in the entity's next one.
    """
    receivers = dict(zip(entity[role == HANDOVER].tolist(), ids[role == HANDOVER].tolist()))
    rows = role != HANDOVER
    entity, ids, ts, cents, own = entity[rows], ids[rows], ts[rows], cents[rows], role[rows] == OWN
    order = np.lexsort((ids, ts, own, entity))
    entity, ids, ts, cents, own = entity[order], ids[order], ts[order], cents[order], own[order]
    # How many rows have left when an own row arrives: a running count over both kinds of moments.
    moment = np.lexsort((own, np.where(own, ts, ts + window_us), entity))
    gone = np.empty(len(own), np.int64)
    gone[moment] = np.cumsum(~own[moment])
    start = np.flatnonzero(np.concatenate(([True], entity[1:] != entity[:-1]))) if len(entity) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(entity)))
    left_before = np.concatenate(([0], np.cumsum(~own)))[start]  # of earlier entities
    at = np.flatnonzero(own)
    left = (np.repeat(start - left_before, size) + gone)[at]
    right = at + 1
    total = right - left + (int(extra[1].sum()) if extra else 0)
    follows = np.zeros(len(at), np.int64)
    last = np.ones(len(at), bool)
    last[:-1] = entity[at[1:]] != entity[at[:-1]]
    follows[:-1] = ids[at[1:]]
    handed = [receivers.get(e) for e in entity[at[last]].tolist()]
    follows[last] = [r or 0 for r in handed]
    keep = np.ones(len(at), bool)
    keep[last] = [r is not None for r in handed]
    if not keep.any():
        return np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros(0, np.int64)
    left, right, total = left[keep], right[keep], total[keep]
    return follows[keep], _quartiles(RangeRanks(cents, extra), left, right, total), total
