"""Isolation forest (Liu, Ting, Zhou 2008): trees on small Spark-drawn samples, scored in batches.

Each of the 200 trees sees at most 256 rows, whatever the size of the data, so the sample and the
model are bounded by the forest's own parameters. Sampling hashes the transaction id: the same rows
are drawn again on a retry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from riskloom.operators.quantile_cut import exact_quantiles
from riskloom.session import cut_lineage

# Fixed values.
FOREST_FEATURES = [
    "amount", "amount_zscore", "txn_count_last_10min", "txn_count_last_60min", "recent_failed_count_15min",
    "distinct_merchants_30d", "distinct_devices_30d", "customer_amount_iqr_score", "merchant_amount_iqr_score",
    "frequency_deviation_zscore", "hour", "is_new_device", "is_new_location",
]
TREES, TREE_ROWS, SEED = 200, 256, 42

_NODE = "tree int, node int, feature int, threshold double, left int, right int, path double"

# Rows whose walks through all trees stay in cache together.
BLOCK_ROWS = 1024


def _expected_depth(n: float) -> float:
    """Average path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _draw(seed: int, *cols) -> Column:
    """Uniform number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def _tree_samples(train: DataFrame, rows: int, trees: int, tree_rows: int, seed: int) -> DataFrame:
    """(tree, draw, x...) with a few more than ``tree_rows`` rows per tree, none twice in a tree.

    Large data is first thinned in one cheap pass to about the rows the forest can use, one tree
    each; small data is handed to several neighbouring trees per row.
    """
    wanted = 1.2 * trees * tree_rows
    who = F.col("transaction_id")
    pool = train if rows <= wanted else train.filter(_draw(seed, who) < wanted / rows)
    copies = min(trees, max(1, int(np.ceil(wanted / max(rows, 1)))))
    first = F.floor(_draw(seed + 1, who) * trees)
    tree = F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda j: F.pmod(first + j, F.lit(trees)).cast("int")))
    return pool.select("*", tree.alias("tree")).withColumn("draw", _draw(seed + 2, who, F.col("tree")))


def _grow(tree_rows: int, seed: int, width: int):
    limit = int(np.ceil(np.log2(max(tree_rows, 2))))

    def one_tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        pdf = pdf.sort_values(["draw", "transaction_id"]).head(tree_rows)
        x = np.stack(pdf["x"].to_numpy()).astype(float).reshape(-1, width)
        rng, nodes, todo = np.random.default_rng([seed, tree]), [], [(0, np.arange(len(x)), 0)]
        free = 1
        while todo:
            node, rows, depth = todo.pop()
            part = x[rows]
            low, high = part.min(axis=0), part.max(axis=0)
            open_features = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(open_features):
                nodes.append((tree, node, -1, 0.0, node, node, depth + _expected_depth(len(rows))))
                continue
            f = int(rng.choice(open_features))
            cut = float(rng.uniform(low[f], high[f]))
            goes_left = part[:, f] <= cut
            nodes.append((tree, node, f, cut, free, free + 1, 0.0))
            todo += [(free, rows[goes_left], depth + 1), (free + 1, rows[~goes_left], depth + 1)]
            free += 2
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

    return one_tree


@dataclass(frozen=True)
class Forest:
    """Fitted forest: node arrays (bounded by trees x rows per tree), medians, score range."""

    medians: dict[str, float]
    nodes: dict[str, np.ndarray]
    sample_rows: int
    low: float = 0.0
    high: float = 1.0

    def matrix_columns(self) -> list[Column]:
        return [F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in FOREST_FEATURES]

    def raw_score(self, df: DataFrame, into: str) -> DataFrame:
        """2 ** (-mean path / expected path), higher = more anomalous."""
        spark = df.sparkSession
        shared = spark.sparkContext.broadcast(self.nodes)
        scale = _expected_depth(self.sample_rows)

        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            nodes = shared.value
            # A leaf is its own child and sends every value left, so a walk needs no test for the end.
            leaf = nodes["feature"] < 0
            feature = np.where(leaf, 0, nodes["feature"]).astype(np.int32)
            threshold = np.where(leaf, np.inf, nodes["threshold"])
            children = np.stack([nodes["left"], nodes["right"]], axis=1).astype(np.int32).ravel()
            roots, path = nodes["roots"].astype(np.int32), nodes["path"]
            for columns in batches:
                x = np.column_stack([c.to_numpy(float) for c in columns])
                total = np.empty(len(x))
                for start in range(0, len(x), BLOCK_ROWS):  # all trees of a block of rows walk together
                    part = np.ascontiguousarray(x[start:start + BLOCK_ROWS])
                    flat, base = part.ravel(), (np.arange(len(part), dtype=np.int32) * part.shape[1])[:, None]
                    at = np.broadcast_to(roots, (len(part), len(roots)))
                    for _ in range(int(nodes["depth"])):
                        at = children[2 * at + (flat[base + feature[at]] > threshold[at])]
                    total[start:start + len(part)] = path[at].sum(axis=1)
                yield pd.Series(np.exp2(-total / len(roots) / scale))

        udf = F.pandas_udf(score, DoubleType())
        return df.withColumn(into, udf(*self.matrix_columns()))

    def with_range(self, raw: DataFrame) -> Forest:
        span = raw.agg(F.min("_raw"), F.max("_raw")).first()
        return replace(self, low=span[0], high=span[1])

    def normalized(self, raw: DataFrame, into: str = "isolation_forest_score") -> DataFrame:
        """Min-max by the fitting rows' range, clipped to [0, 1]."""
        unit = (F.col("_raw") - self.low) / ((self.high - self.low) or 1.0)
        return raw.withColumn(into, F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0))).drop("_raw")

    def score(self, df: DataFrame, into: str = "isolation_forest_score") -> DataFrame:
        return self.normalized(self.raw_score(df, "_raw"), into)


def fit_forest(
    train: DataFrame, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED, measure: bool = True,
) -> Forest:
    """``measure`` also scores ``train`` once to learn the score range."""
    cuts = exact_quantiles(train, FOREST_FEATURES, [0.5])
    medians = {c: (v[0] if v and v[0] is not None else 0.0) for c, v in cuts.items()}
    draft = Forest(medians, {}, tree_rows)
    rows = train.count()
    x = train.select("transaction_id", F.array(*draft.matrix_columns()).alias("x"))
    grown = (
        _tree_samples(x, rows, trees, tree_rows, seed)
        .repartition(min(trees, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "tree")
        .groupBy("tree").applyInPandas(_grow(tree_rows, seed, len(FOREST_FEATURES)), _NODE)
        .toPandas()  # at most trees * (2 * tree_rows - 1) nodes
    ).sort_values(["tree", "node"]).reset_index(drop=True)
    start = grown.groupby("tree").cumcount().rsub(grown.index.to_series())
    nodes = {
        "feature": grown["feature"].to_numpy(), "threshold": grown["threshold"].to_numpy(),
        "path": grown["path"].to_numpy(), "left": (grown["left"] + start).to_numpy(),
        "right": (grown["right"] + start).to_numpy(), "roots": np.unique(start.to_numpy()),
        "depth": np.array(int(np.ceil(np.log2(max(tree_rows, 2))))),
    }
    fitted = Forest(medians, nodes, min(tree_rows, rows))
    if not measure:
        return fitted
    return fitted.with_range(fitted.raw_score(train, "_raw"))


def fit_and_score(df: DataFrame, train: Column | None, **kw) -> tuple[Forest, DataFrame]:
    """Scores every row once; the range is then read from the written raw scores of the fitting rows."""
    forest = fit_forest(df if train is None else df.filter(train), measure=False, **kw)
    raw = cut_lineage(forest.raw_score(df, "_raw"))
    fitted = forest.with_range(raw if train is None else raw.filter(train))
    return fitted, fitted.normalized(raw)


def with_whole_data_score(df: DataFrame, **kw) -> DataFrame:
    """Unsupervised variant: fitted on and applied to the same rows."""
    return fit_and_score(df, None, **kw)[1]


def with_train_only_score(df: DataFrame, **kw) -> tuple[Forest, DataFrame]:
    """Fitted on split = 'train' only, applied to every row; later rows are clipped into its range."""
    return fit_and_score(df, F.col("split") == "train", **kw)
