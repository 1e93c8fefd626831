"""Training of gradient-boosted trees: MLlib's algorithm and model, other means.

MLlib adds every feature of every row by itself, at each level of each tree. Here rows are kept as bin numbers, and features
share columns: the bins of several features are the digits of one code of at most ``CODES`` values. A level is one job that makes
a histogram of each column's codes by node, and each feature's own histogram is a sum over it. Tasks return histograms, bounded
by nodes and bins; margins stay with the rows, in the executors' storage. All rows, features, trees and levels take part.

What is kept of MLlib: 32 bins from the same split candidates (on over 10,000 rows from a sample of that size, as there),
variance gain, at least one row a child, the first of equal gains by feature and split, log loss, the first tree unshrunk, leaves
of equal value merged. Residuals are rounded to a fixed point, as fine as the sum of all weights allows, so sums of them are
exact and the trees do not depend on how rows are dealt to tasks, nor does the choice among equal gains depend on rounding.
Nodes of the model hold no sum of squares (NaN).
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml import classification as ml
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from riskloom.session import ROWS_PER_TASK, cut_lineage, ensure_checkpoint_dir

#: Values of a code: with 16 nodes of a level, sums of one code stay in a core's cache.
CODES = 1_024
BLOCK_ROWS = 1 << 18
#: Both classes are counted in one sum: rows of the second count so much each, and the sum stays an exact double.
SECOND = 1 << 26
#: After so many trees the margins are worked out anew from all trees, so that no chain of steps grows longer.
CHAIN_TREES = 50
SAMPLE_ROWS = 10_000
#: Rows of a task are in memory whole, about 60 bytes each while a level is counted.
TASK_ROWS = 1_000_000


def _candidates(values: np.ndarray, weights: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Thresholds of one feature, as MLlib finds them; what is missing of the ``expected`` weight counts as zeros."""
    used = values != 0
    known, at = np.unique(values[used], return_inverse=True)
    if not len(known):
        return np.empty(0)
    counts = np.bincount(at, weights[used])
    zeros = expected - counts.sum()
    if zeros > np.finfo(float).eps * used.sum() * 100:
        place = int(np.searchsorted(known, 0.0))
        known, counts = np.insert(known, place, 0.0), np.insert(counts, place, zeros)
    middle = (known[:-1] + known[1:]) / 2
    if len(middle) <= most:
        return middle
    stride = expected / (most + 1)
    out, reached, target = [], counts[0], stride
    for i in range(1, len(known)):
        before, reached = reached, reached + counts[i]
        if abs(before - target) < abs(reached - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def _bundles(sizes: list[int]) -> list[list[int]]:
    """Features with more than one bin, in groups whose bins multiply to at most ``CODES`` (or one feature alone)."""
    groups: list[tuple[int, list[int]]] = []
    for f in sorted((f for f, n in enumerate(sizes) if n > 1), key=lambda f: -sizes[f]):
        k = next((k for k, (size, _) in enumerate(groups) if size * sizes[f] <= CODES), None)
        if k is None:
            groups.append((sizes[f], [f]))
        else:
            groups[k] = groups[k][0] * sizes[f], [*groups[k][1], f]
    return [g for _, g in groups]


@dataclass(frozen=True)
class Bins:
    """How values become codes. ``place``: feature -> (bundle, stride of its digit)."""

    cuts: list[np.ndarray]
    bundles: list[list[int]] = field(init=False)
    place: dict[int, tuple[int, int]] = field(init=False)

    def __post_init__(self):
        bundles = _bundles([len(c) + 1 for c in self.cuts])
        place = {}
        for b, group in enumerate(bundles):
            stride = 1
            for f in group:
                place[f] = b, stride
                stride *= len(self.cuts[f]) + 1
        object.__setattr__(self, "bundles", bundles)
        object.__setattr__(self, "place", place)

    def size(self, bundle: int) -> int:
        return int(np.prod([len(self.cuts[f]) + 1 for f in self.bundles[bundle]]))

    def digit(self, f: int) -> np.ndarray:
        """The bin of feature ``f`` for each code of its bundle."""
        b, stride = self.place[f]
        return np.arange(self.size(b)) // stride % (len(self.cuts[f]) + 1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.bundles), len(x)), dtype=np.uint16)
        for f, (b, stride) in self.place.items():
            out[b] += (np.searchsorted(self.cuts[f], x[:, f], "left") * stride).astype(np.uint16)
        return out


@dataclass(frozen=True)
class Binned:
    """Training rows as codes: ``rows`` has one record for each batch (n, labels, codes), ``base`` one for each task, with margins of 0."""

    bins: Bins
    rows: DataFrame
    base: RDD
    counts: tuple[int, int]
    weights: tuple[float, float]
    width: int

    @staticmethod
    def of(df: DataFrame, features: str, label: str, weight: str, seed: int, max_bins: int) -> Binned | None:
        """None where rows of one label differ in weight (or weigh nothing): the counts of classes would not do."""
        known = {r["y"]: r for r in df.groupBy(F.col(label).alias("y")).agg(
            F.count("*").alias("n"), F.min(weight).alias("low"), F.max(weight).alias("high")).collect()} if _labels_fit(df, label) else {}
        if not known or any(r["low"] != r["high"] or not r["low"] > 0 for r in known.values()):
            return None
        counts = tuple(known[y]["n"] if y in known else 0 for y in (0.0, 1.0))
        weights = tuple(float(known[y]["low"]) if y in known else 1.0 for y in (0.0, 1.0))
        x = df.select(vector_to_array(features).alias("x"), F.col(label).alias("y"), F.col(weight).alias("w"))
        share = min(1.0, max(max_bins * max_bins, SAMPLE_ROWS) / sum(counts))
        drawn = (x if share == 1 else _drawn(x, share, seed)).select("x", "w").toPandas()  # about SAMPLE_ROWS rows
        values = np.stack(drawn["x"].to_numpy())
        expected, most = share * sum(n * w for n, w in zip(counts, weights)), min(max_bins, sum(counts)) - 1
        bins = Bins([_candidates(column, drawn["w"].to_numpy(), expected, most) for column in values.T])
        coded = cut_lineage(_coded(x, bins))
        tasks = max(1, -(-sum(counts) // TASK_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-sum(counts) // ROWS_PER_TASK)))
        base = coded.repartition(tasks).rdd.mapPartitions(lambda records: [_Rows.gathered(records, bins)])
        return Binned(bins, coded, base.persist(StorageLevel.MEMORY_AND_DISK), counts, weights, values.shape[1])


def _drawn(x: DataFrame, share: float, seed: int) -> DataFrame:
    """The rows that MLlib draws from the same partitions with the same seed."""
    session = x.sparkSession
    number = session._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    return DataFrame(session._jsparkSession.createDataFrame(x._jdf.javaRDD().sample(False, share, number), x._jdf.schema()), session)


def _labels_fit(df: DataFrame, label: str) -> bool:
    return not df.filter(F.col(label).isNull() | ~F.col(label).isin(0.0, 1.0)).limit(1).count()


def _coded(x: DataFrame, bins: Bins) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            if not np.isfinite(values).all():
                raise ValueError("features must not be NaN or infinite")
            labels = batch.column(1).to_numpy().astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([labels.tobytes()], pa.binary()),
                                              pa.array([bins.codes(values).tobytes()], pa.binary())], names=["n", "labels", "codes"])

    return x.select("x", "y").mapInArrow(run, "n long, labels binary, codes binary")


def _unpacked(packed: np.ndarray) -> np.ndarray:
    second = np.floor(packed / SECOND)
    return np.stack([packed - second * SECOND, second])


class _Rows:
    """One task's rows (labels, codes, margins) and what they go through: histograms of a level, the way down, margins."""

    def __init__(self, held: tuple, bins: Bins):
        self.bins = bins
        self.labels, self.codes, self.margin = held
        self.node, self.pull = np.ones(len(self.labels), np.int64), None

    @staticmethod
    def gathered(batches, bins: Bins) -> tuple:
        labels, codes = [np.empty(0, np.uint8)], [np.empty((len(bins.bundles), 0), np.uint16)]
        for n, y, c in batches:
            labels.append(np.frombuffer(y, np.uint8))
            codes.append(np.frombuffer(c, np.uint16).reshape(-1, n))
        joined = np.concatenate(labels)
        return joined, np.concatenate(codes, axis=1), np.zeros(len(joined))

    def blocks(self):
        return (slice(k, k + BLOCK_ROWS) for k in range(0, len(self.labels), BLOCK_ROWS))

    def residuals(self, first: bool, weights: tuple[float, float], scale: float) -> None:
        sign = self.labels * 2.0 - 1
        plain = sign if first else 4 * sign / (1 + np.exp(2 * sign * self.margin))
        self.pull = np.rint(np.where(self.labels == 1, weights[1], weights[0]) * plain * scale)

    def histograms(self, nodes: list[int], counted: bool) -> np.ndarray:
        """(nodes, bins of all features in bundle order) of the sums of residuals; if ``counted``, before it two of the rows of both classes."""
        root = nodes == [1]
        slot = np.full(max(nodes) + 2, len(nodes))  # rows elsewhere share the slot behind the last
        slot[nodes] = np.arange(len(nodes))
        places = [0 if root else slot[np.minimum(self.node[k], len(slot) - 1)] for k in self.blocks()]
        counting = np.where(self.labels == 1, float(SECOND), 1.0)
        out = []
        for b, group in enumerate(self.bins.bundles):
            size = self.bins.size(b)
            flat, cells = size * (len(nodes) + 1), size * len(nodes)
            counts, pulls, packed, held = np.zeros((2, cells)), np.zeros(cells), np.zeros(cells), 0
            for place, k in zip(places, self.blocks()):
                index = self.codes[b, k].astype(np.int64) if root else self.codes[b, k] + place * size
                pulls += np.bincount(index, self.pull[k], flat)[:cells]
                if counted:
                    packed += np.bincount(index, counting[k], flat)[:cells]
                    held += BLOCK_ROWS
                    if held + BLOCK_ROWS > SECOND:
                        counts, packed, held = counts + _unpacked(packed), np.zeros(cells), 0
            sums = np.stack([*(counts + _unpacked(packed)), pulls] if counted else [pulls])
            bins_of = np.concatenate([self.bins.digit(f)[:, None] == np.arange(len(self.bins.cuts[f]) + 1) for f in group], axis=1)
            out.append((sums.reshape(-1, size) @ bins_of.astype(float)).reshape(len(sums), len(nodes), -1))
        return np.concatenate(out, axis=2)

    def descend(self, splits: dict[int, tuple[int, int]]) -> None:
        """Rows of a node in ``splits`` (node -> feature, last bin to the left) go to its children 2n and 2n + 1."""
        top = max(splits) + 1
        size = max(self.bins.size(b) for b in range(len(self.bins.bundles)))
        bundle, shift = np.zeros(top + 1, np.int64), np.zeros((top + 1, size), np.int8)
        moves = np.zeros(top + 1, bool)
        for n, (f, cut) in splits.items():
            bundle[n], moves[n] = self.bins.place[f][0], True
            right = self.bins.digit(f) > cut
            shift[n, :len(right)] = right
        flat = self.codes.ravel()
        rows = len(self.labels)
        for k in self.blocks():
            node = self.node[k]
            at = np.minimum(node, top)
            code = flat[bundle[at] * rows + np.arange(k.start, k.start + len(node))]
            self.node[k] = np.where(moves[at], 2 * node + shift.ravel()[at * size + code], node)

    def finish(self, values: np.ndarray, rate: float) -> None:
        """Adds the leaves' values to the margins; all rows are at the root again."""
        self.margin += rate * values[self.node]
        self.node[:] = 1


@dataclass
class Tree:
    """Nodes are numbered as in a heap, from 1; ``sums``: rows of both classes and the sum of scaled residuals."""

    rate: float
    sums: dict[int, np.ndarray]
    levels: list[dict[int, tuple[int, int]]] = field(default_factory=list)
    gains: dict[int, float] = field(default_factory=dict)

    def values(self, weights: tuple[float, float], scale: float) -> np.ndarray:
        out = np.zeros(max(self.sums) + 1)
        for n, (negatives, positives, pull) in self.sums.items():
            out[n] = pull / scale / (weights[0] * negatives + weights[1] * positives)
        return out


def _best(bins: Bins, options: list[tuple[int, int]], found: np.ndarray, whole: np.ndarray, weights: tuple[float, float], scale: float):
    """Per node the first of the best candidates, its gain and the sums to its left."""
    order = [f for group in bins.bundles for f in group]
    starts = dict(zip(order, np.cumsum([0, *[len(bins.cuts[f]) + 1 for f in order]]).tolist()))
    running = np.concatenate([np.cumsum(found[:, :, starts[f]:starts[f] + len(bins.cuts[f])], axis=2) for f in sorted(order)], axis=2)
    rest = whole[:, :, None] - running
    mine, others = (weights[0] * s[0] + weights[1] * s[1] for s in (running, rest))
    with np.errstate(divide="ignore", invalid="ignore"):
        here, there = running[2] / mine, rest[2] / others
        apart = np.where(np.abs(here - there) > 2.0 ** -50 * np.maximum(np.abs(here), np.abs(there)), (here - there) / scale, 0.0)
        gain = mine * others / (mine + others) ** 2 * apart ** 2
    gain = np.where((mine > 0) & (others > 0), gain, -1.0)  # the weights come from whole numbers of rows
    chosen, pick = gain.argmax(axis=1), np.arange(len(gain))
    return [options[c] for c in chosen], gain[pick, chosen], running[:, pick, chosen]


def _replayed(held: tuple, bins: Bins, trees: list[tuple[list, np.ndarray, float]]) -> tuple:
    rows = _Rows(held, bins)
    rows.margin = rows.margin.copy()
    for levels, values, rate in trees:
        for splits in levels:
            rows.descend(splits)
        rows.finish(values, rate)
    return rows.labels, rows.codes, rows.margin


@dataclass(frozen=True)
class Task:
    """What a task needs besides its rows."""

    bins: Bins
    counts: tuple[int, int]
    weights: tuple[float, float]
    scale: float

    def sums(self, rows: _Rows, nodes: list[int], first: bool, counted: bool) -> tuple[float, np.ndarray]:
        if nodes == [1] or rows.pull is None:
            rows.residuals(first, self.weights, self.scale)
        return rows.pull.sum(), rows.histograms(nodes, counted) if self.bins.bundles else np.zeros((1, 1, 0))

    def told(self, tree: Tree) -> tuple:
        return tree.levels, tree.values(self.weights, self.scale), tree.rate


class _Alone:
    """Rows of one task, which grows all trees by itself: nothing has to be exchanged."""

    def __init__(self, task: Task, held: tuple):
        self.task, self.rows = task, _Rows(held, task.bins)
        self.rows.margin = self.rows.margin.copy()

    def follow(self, made: list[Tree]) -> None:
        levels, values, rate = self.task.told(made[-1])
        self.rows.node[:] = 1
        for splits in levels:
            self.rows.descend(splits)
        self.rows.finish(values, rate)

    def sums(self, first: bool, levels: list, nodes: list[int], counted: bool):
        if levels:
            self.rows.descend(levels[-1])
        return self.task.sums(self.rows, nodes, first, counted)


def _step(task: Task):
    """What a task of any job does with its rows: go on behind trees, or the sums of a level."""
    def step(held: tuple, trees: list | None, asked: tuple):
        if trees is not None:
            return _replayed(held, task.bins, trees)
        first, levels, nodes, counted = asked
        rows = _Rows(held, task.bins)
        for splits in levels:
            rows.descend(splits)
        return task.sums(rows, nodes, first, counted)

    return step


class _ByValue:
    """A function that a broadcast carries by value; a worker reads the function itself."""

    def __init__(self, function):
        self.function = function

    def __reduce__(self):
        return cloudpickle.loads, (cloudpickle.dumps(self.function),)


class _Dealt:
    """Rows of many tasks. The margins behind the last tree are stored; where they are lost, Spark makes them again.

    The code is broadcast, so that a worker builds it once and not for every task of the many short jobs.
    """

    def __init__(self, task: Task, base: RDD):
        self.task, self.base, self.state = task, base, base
        self.step = base.context.broadcast(_ByValue(_step(task)))

    def follow(self, made: list[Tree]) -> None:
        anew, step = len(made) % CHAIN_TREES == 0, self.step
        since = [self.task.told(tree) for tree in (made if anew else made[-1:])]
        self.behind = self.state
        self.state = (self.base if anew else self.state).mapPartitions(lambda part: [step.value(held, since, ()) for held in part])
        self.state.persist(StorageLevel.MEMORY_AND_DISK)

    def sums(self, first: bool, levels: list, nodes: list[int], counted: bool):
        step, asked = self.step, (first, levels, nodes, counted)
        found = self.base.context.runJob(self.state, lambda part: [step.value(held, None, asked) for held in part])
        if nodes == [1] and not first and self.behind is not self.base:  # read for the last time
            self.behind.unpersist()
        return sum(f[0] for f in found), sum(f[1] for f in found)

    def close(self) -> None:
        if self.state is not self.base:
            self.state.unpersist()


def _grow(task: Task, rows: _Alone | _Dealt, depth: int, trees: int, rate: float) -> list[Tree]:
    """The trees, level by level."""
    bins, made, at_root = task.bins, [], None
    # Candidates in the order of features and cuts: the first of equal gains is taken.
    options = [(f, cut) for f in sorted(bins.place) for cut in range(len(bins.cuts[f]))]
    for number in range(trees):
        if number:
            rows.follow(made)
        pull, found = rows.sums(number == 0, [], [1], at_root is None)
        at_root = found[:2] if at_root is None else at_root  # the same for every tree
        tree = Tree(rate if number else 1.0, {1: np.array([*map(float, task.counts), pull])})
        nodes, found = [1], np.concatenate([at_root, found[-1:]])
        while len(tree.levels) < depth and options:
            if tree.levels:
                found = rows.sums(number == 0, tree.levels, nodes, True)[1]
            chosen, gains, left = _best(bins, options, found, np.stack([tree.sums[n] for n in nodes], axis=1), task.weights, task.scale)
            parted = {}
            for i, n in enumerate(nodes):
                if gains[i] > 0:
                    parted[n], tree.gains[n] = chosen[i], float(gains[i])
                    tree.sums[2 * n], tree.sums[2 * n + 1] = left[:, i], tree.sums[n] - left[:, i]
            if not parted:
                break
            tree.levels.append(parted)
            nodes = [c for n in parted for c in (2 * n, 2 * n + 1)]
        made.append(tree)
    return made


class GBTClassifier(ml.GBTClassifier):
    """MLlib's estimator with its parameters, trained as this module tells; ``fit`` takes rows or ``Binned`` rows."""

    def _fit(self, dataset):
        asked = {p.name: v for p, v in self.extractParamMap().items()}
        binned = dataset if isinstance(dataset, Binned) else Binned.of(
            dataset, asked["featuresCol"], asked["labelCol"], asked["weightCol"], asked["seed"], asked["maxBins"])
        if binned is None:
            return super()._fit(dataset)
        # The largest power of two at which sums of all residuals (at most 4 each) are exact doubles.
        scale = 2.0 ** math.floor(52 - math.log2(4 * sum(n * w for n, w in zip(binned.counts, binned.weights)) + sum(binned.counts)))
        task, asks = Task(binned.bins, binned.counts, binned.weights, scale), (asked["maxDepth"], asked["maxIter"], asked["stepSize"])
        if binned.base.getNumPartitions() == 1:
            made, = binned.base.map(lambda held: _grow(task, _Alone(task, held), *asks)).collect()
        else:
            dealt = _Dealt(task, binned.base)
            made = _grow(task, dealt, *asks)
            dealt.close()
        if binned is not dataset:
            binned.base.unpersist()
        return _model(self, binned, made, scale)


def _preorder(tree: Tree, weights: tuple[float, float], scale: float, cuts: list[np.ndarray]) -> list[tuple]:
    """Node rows of MLlib's saved form; two leaves of the same value are one."""
    splits = {n: s for level in tree.levels for n, s in level.items()}
    values = tree.values(weights, scale)
    out: list[tuple] = []

    def leaf(n: int) -> bool:
        return n not in splits or (leaf(2 * n) and leaf(2 * n + 1) and values[2 * n] == values[2 * n + 1])

    def put(n: int) -> int:
        at, (negatives, positives, pull) = len(out), tree.sums[n].tolist()
        head = (float(values[n]), math.nan, [weights[0] * negatives + weights[1] * positives, pull / scale, math.nan], int(negatives + positives))
        if leaf(n):
            out.append((at, *head, -1.0, -1, -1, (-1, [], -1)))
            return at
        out.append(())
        left, right = put(2 * n), put(2 * n + 1)
        f, cut = splits[n]
        out[at] = (at, *head, tree.gains[n], left, right, (f, [float(cuts[f][cut])], -1))
        return at

    put(1)
    return out


def _model(learner: GBTClassifier, binned: Binned, made: list[Tree], scale: float) -> ml.GBTClassificationModel:
    """MLlib's model, by way of its saved form."""
    spark = binned.rows.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/boosted-{uuid.uuid4().hex[:8]}"
    table = [(i, row) for i, tree in enumerate(made) for row in _preorder(tree, binned.weights, scale, binned.bins.cuts)]
    spark.createDataFrame(table, """treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>,
        rawCount long, gain double, leftChild int, rightChild int,
        split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>""").coalesce(1).write.parquet(f"{path}/data")
    own = {p.name: v for p, v in learner._paramMap.items()}
    defaults = {p.name: v for p, v in learner._defaultParamMap.items()}
    head = {"timestamp": 0, "sparkVersion": spark.version}
    of_tree = ("featuresCol", "labelCol", "maxDepth", "weightCol", "seed")
    tree = {**head, "class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel",
            "paramMap": {k: own[k] for k in of_tree if k in own},
            "defaultParamMap": {k: defaults[k] for k in ("maxDepth", "maxBins", "seed", "featuresCol", "labelCol", "predictionCol") if k in defaults}}
    told = [(i, json.dumps({**tree, "uid": f"dtr_{uuid.uuid4().hex[:12]}"}), t.rate) for i, t in enumerate(made)]
    spark.createDataFrame(told, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = {**head, "class": "org.apache.spark.ml.classification.GBTClassificationModel", "uid": learner.uid, "paramMap": own,
             "defaultParamMap": defaults, "numFeatures": binned.width, "numTrees": len(made)}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return ml.GBTClassificationModel.load(path)
