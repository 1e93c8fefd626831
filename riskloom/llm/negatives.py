"""Hard negatives by bounds along a spanning tree of anchors.

Anchors are dealt into blocks of at most ``BLOCK`` by their place along a fixed direction, and each block gets a minimum
spanning tree. A task walks the tree for every batch of candidates: for a child anchor ``c`` of ``p`` and a candidate ``x``,
``|<x, c> - <x, p>| <= |x| * |c - p|``. So a candidate's score at the parent, exact or itself an interval, gives an interval at
the child (also ``|x| * |c|`` bounds it). Only candidates whose interval meets the window in which scores matter are scored
again; the others pass their wider interval on. Nothing is lost.

There are two walks. The first finds each anchor's positives: the window is open above and begins at the task's k-th best
score so far. The second finds the negatives of each positive: scores between ``low`` and ``high`` times the
positive's score. Tasks return their best rows of each list, and a window takes the best of all. Blocks are walked one after
the other, each stored before the next is sent out, so neither the driver nor a task holds more than one.

Components become ``floor(256 * x)``; scores are integer inner products, exact in double precision while they stay
below 2^53 and computed by integer arithmetic beyond that (results are held inside the range of a long).

Rows with a null id, label or vector, or with a null or non-finite component take no part, nor do those whose length is not
the most common one. Rows that repeat a candidate's id count each; an anchor whose id repeats is the one of least label,
then vector, and never finds rows of its own id. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from riskloom.llm.common import ragged
from riskloom.operators.ordering import dense_ids
from riskloom.session import cut_lineage

#: Anchors of a block at most, and candidates that walk a tree at once. A path-like tree holds two intervals of each
#: candidate for each anchor: 64 MB.
BLOCK = 4096
CANDIDATES = 1000
SCALE = 256
SEED = 11
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def valid(df: DataFrame, id_column: str, label: str, vector: str) -> DataFrame:
    """vec_id, label, vector (whole numbers as doubles) of the rows that take part."""
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                     F.col(vector).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vector") == (size["d"] if size else 0))


def scaled(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """Components to whole numbers. (As doubles: floor of a column would give a long, which large components overflow.)"""
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(2))
            whole = ragged(np.floor(x * scale).ravel(), np.full(len(x), x.shape[1]), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), whole], names=["vec_id", "label", "vector"])

    return rows.select("vec_id", "label", "vector").mapInArrow(run, rows.schema)


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the rows of ``x`` (Prim): rows in depth-first order, and for each place in that order the
    place of the parent (-1 for the root) and the distance to it."""
    n = len(x)
    # Squares of very large components would not fit; distances are taken on a scale where they do.
    scale = max(1.0, float(np.abs(x).max(initial=0.0)))
    x = x / scale
    square = (x * x).sum(axis=1)
    best, parent, out = np.full(n, np.inf), np.full(n, -1), np.ones(n, dtype=bool)
    children: list[list[int]] = [[] for _ in range(n)]
    now = 0
    for _ in range(n - 1):
        out[now] = False
        d = square + square[now] - 2 * (x @ x[now])
        nearer = out & (d < best)
        best[nearer], parent[nearer] = d[nearer], now
        now = int(np.argmin(np.where(out, best, np.inf)))
        children[parent[now]].append(now)
    order, above, place, todo = [], [], np.empty(n, dtype=np.int64), [0] if n else []
    while todo:
        v = todo.pop()
        place[v] = len(order)
        order.append(v)
        above.append(-1 if parent[v] < 0 else int(place[parent[v]]))
        todo += children[v]
    order, above = np.array(order, dtype=np.int64), np.array(above, dtype=np.int64)
    edge = np.where(above < 0, 0.0, np.linalg.norm(x[order] - x[order[np.maximum(above, 0)]], axis=1) * scale)
    return order, above, edge


_TREE = StructType([StructField("block", LongType()), StructField("place", IntegerType()), StructField("parent", IntegerType()),
                    StructField("edge", DoubleType()), StructField("vec_id", LongType()), StructField("label", LongType()),
                    StructField("vector", ArrayType(DoubleType()))])


def trees(anchors: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """A spanning tree of each block of anchors, stored: block, place (depth-first), parent, edge, and the anchor."""
    along = F.transform("vector", lambda v, i: v * F.sin((i + 1) * (i + seed)))
    rows = anchors.withColumn("along", F.aggregate(along, F.lit(0.0), lambda a, v: a + v))
    dealt = dense_ids(rows, "at", [F.col("along"), F.col("vec_id")]).withColumn("block", F.floor((F.col("at") - 1) / block))

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("at", "ascending")])
        order, above, edge = spanning_tree(_matrix(table.column("vector").combine_chunks()))
        part = table.take(pa.array(order))
        return pa.table([part.column("block"), pa.array(np.arange(len(order)), pa.int32()), pa.array(above, pa.int32()), pa.array(edge),
                         *(part.column(c) for c in ("vec_id", "label", "vector"))], names=_TREE.names)

    return cut_lineage(dealt.select("block", "at", "vec_id", "label", "vector").groupBy("block").applyInArrow(build, _TREE))


@dataclass
class Tree:
    """One block on the driver and in tasks."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    #: Whether an anchor has children.
    inner: np.ndarray
    #: For the second walk: ids and scores of each anchor's positives.
    positives: dict[int, list[tuple[int, int]]] | None = None


class Candidates:
    """A batch of candidates, whose scores at an anchor are intervals until they are computed."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids, self.labels, self.x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
        self.most = float(np.abs(self.x).max(initial=0.0))
        with np.errstate(over="ignore"):
            self.norm = np.linalg.norm(self.x, axis=1) * (1 + 1e-9)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer inner products (as long) of some candidates with an anchor."""
        if self.most * max(1.0, float(np.abs(anchor).max(initial=0.0))) * len(anchor) < _EXACT:
            return (self.x[rows] @ anchor).astype(np.int64)
        own = [int(v) for v in anchor]
        exact = (sum(int(v) * w for v, w in zip(self.x[r], own)) for r in rows.tolist())
        return np.array([max(-_LONG, min(_LONG, s)) for s in exact], dtype=np.int64)

    def walk(self, tree: Tree, wanted):
        """For each anchor, with the rows that may lie in its window and their exact scores.

        ``wanted(place)`` gives the rows that count at all for an anchor (a mask) and its window (least, greatest).
        """
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.linalg.norm(tree.vectors, axis=1)
            held: list[tuple[int, np.ndarray, np.ndarray]] = []  # the way from the root: place, lower and upper bounds
            for place in range(len(tree.ids)):
                while held and held[-1][0] != tree.parent[place]:
                    held.pop()
                far = self.norm * length[place]
                low, high = -far, far
                if held:
                    step = self.norm * tree.edge[place]
                    low, high = np.maximum(low, held[-1][1] - step), np.minimum(high, held[-1][2] + step)
                mask, least, greatest = wanted(place)
                # Room for rounding; sums that are no numbers bound nothing.
                slack = 1e-6 * (1 + np.abs(far))
                rows = np.flatnonzero(mask & ~(high + slack < least) & ~(low - slack > greatest))
                score = self.scores(rows, tree.vectors[place])
                if tree.inner[place]:
                    low, high = low - slack, high + slack
                    low[rows], high[rows] = score, score
                    held.append((place, low, high))
                yield place, rows, score


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; ties go to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _positives(tree: Tree, k: int, batches):
    """anchor_id, vec_id, score: the task's k best rows of each anchor's label."""
    ids = [np.zeros(0, np.int64)] * len(tree.ids)
    scores = [np.zeros(0, np.int64)] * len(tree.ids)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = Candidates(batch)
        of_label = {v: np.flatnonzero(rows.labels == v) for v in np.unique(rows.labels)}

        def wanted(a):
            mask = np.zeros(len(rows.ids), dtype=bool)
            mask[of_label.get(tree.labels[a], [])] = True
            mask &= rows.ids != tree.ids[a]
            return mask, scores[a][-1] if len(scores[a]) == k else -np.inf, np.inf

        for a, found, score in rows.walk(tree, wanted):
            if len(found):
                i, s = np.concatenate((ids[a], rows.ids[found])), np.concatenate((scores[a], score))
                keep = _best(i, s, k)
                ids[a], scores[a] = i[keep], s[keep]
    n = [len(i) for i in ids]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(tree.ids, n)), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)])),
         pa.array(np.concatenate([*scores, np.zeros(0, np.int64)]))], names=["anchor_id", "vec_id", "score"])


def _in_window(score: np.ndarray, positive: int, low: int, high: int) -> np.ndarray:
    """low * positive <= 100 * score <= high * positive, without overflow."""
    least, greatest = -(-low * positive // 100), high * positive // 100
    return (score >= max(-_LONG, min(_LONG, least))) & (score <= max(-_LONG, min(_LONG, greatest)))


def _negatives(tree: Tree, k: int, low: int, high: int, batches):
    """anchor_id, positive_id, positive_score, negative_id, negative_score: the task's k best of each list."""
    lists = [[(p, s, np.zeros(0, np.int64), np.zeros(0, np.int64)) for p, s in tree.positives.get(int(a), [])] for a in tree.ids]
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = Candidates(batch)

        def wanted(a):
            if not lists[a]:
                return np.zeros(len(rows.ids), dtype=bool), 0, 0
            # A list that is full only takes scores from its worst one on.
            least = min(max(low * s / 100, float(held[-1]) if len(held) == k else -np.inf) for _, s, _, held in lists[a])
            mask = (rows.labels != tree.labels[a]) & (rows.ids != tree.ids[a])
            return mask, least, max(high * s / 100 for _, s, _, _ in lists[a])

        for a, found, score in rows.walk(tree, wanted):
            if not len(found):
                continue
            for at, (p, s, ids, scores) in enumerate(lists[a]):
                good = _in_window(score, s, low, high)
                if good.any():
                    i, v = np.concatenate((ids, rows.ids[found[good]])), np.concatenate((scores, score[good]))
                    keep = _best(i, v, k)
                    lists[a][at] = (p, s, i[keep], v[keep])
    flat = [(int(tree.ids[a]), p, s, int(i), int(v)) for a in range(len(tree.ids)) for p, s, ids, scores in lists[a] for i, v in zip(ids, scores)]
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], pa.int64()) for c in range(5)], names=names)


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


def _top(rows: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each key, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, vector (whole numbers) of all candidates; ``anchors``: those of them to be anchors, a stated set.
    For each of an anchor's ``positives`` best rows of its own label, the ``negatives`` best rows of other labels whose score
    lies between ``low`` and ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    anchors = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a")).select("vec_id", "a.label", "a.vector")
    forest = trees(anchors, block)
    n_blocks = (forest.agg(F.max("block")).first()[0] + 1) if forest.limit(1).count() else 0
    found = None

    def walk(held, job, schema):
        return rows.mapInArrow(lambda batches: job(held.value, batches), schema)

    for b in range(n_blocks):
        own = forest.filter(F.col("block") == b).orderBy("place").toArrow().combine_chunks()
        tree = Tree(own.column("vec_id").to_numpy(), own.column("label").to_numpy(), _matrix(own.column("vector").combine_chunks()),
                    parent := own.column("parent").to_numpy(), own.column("edge").to_numpy(), np.isin(np.arange(len(parent)), parent))
        held = spark.sparkContext.broadcast(tree)
        best = _top(walk(held, lambda t, x: _positives(t, positives, x), _longs("anchor_id", "vec_id", "score")),
                    ["anchor_id"], "score", "vec_id", positives)
        # At most BLOCK * positives rows.
        tree.positives = {}
        for r in best.orderBy("anchor_id", "rank").collect():
            tree.positives.setdefault(r["anchor_id"], []).append((r["vec_id"], r["score"]))
        held.destroy()
        held = spark.sparkContext.broadcast(tree)
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        hard = cut_lineage(_top(walk(held, lambda t, x: _negatives(t, negatives, low, high, x), _longs(*names)),
                           ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives))
        held.destroy()
        found = hard if found is None else found.unionByName(hard)
    if found is None:
        found = spark.createDataFrame([], StructType([*_longs("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"),
                                                      StructField("rank", IntegerType())]))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(df: DataFrame, id_column: str, label: str, vector: str, every: int, scale: int = SCALE, **options) -> DataFrame:
    """``mine`` over all valid rows of a table, with those as anchors whose id is divisible by ``every``."""
    rows = cut_lineage(scaled(valid(df, id_column, label, vector), scale))
    return mine(rows, rows.filter(F.col("vec_id") % every == 0), **options)
