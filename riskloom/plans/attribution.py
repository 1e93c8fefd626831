"""Why a score is what it is: exact additive contributions, globally and per row.

Linear model: coefficient x (value - train mean), plain column expressions. Boosted trees:
path-dependent Shapley values (Lundberg et al. 2018), computed in Arrow batches over the broadcast
trees -- a model of bounded size -- and aggregated by Spark. A leaf costs the square of its depth for
each pattern of conditions that occurs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from riskloom.plans.models import Prepared
from riskloom.session import ensure_checkpoint_dir

#: Features of a path up to which a task keeps the contributions of all patterns of conditions: 2 KB a leaf at most.
TABLE_FEATURES = 5


def linear_contributions(prepared: Prepared, model) -> DataFrame:
    """Adds ``contributions`` (array, feature order) and ``base``; base + sum = log-odds."""
    names = prepared.preprocessor.names
    train = prepared.part("train").select(vector_to_array("scaled").alias("v"))
    means = train.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(len(names))]).first()
    coefficients = model.coefficients.toArray()
    base = float(model.intercept + sum(c * m for c, m in zip(coefficients, means)))
    value = F.col("_v")
    shares = F.array(*[(value[i] - float(means[i])) * float(coefficients[i]) for i in range(len(names))])
    return prepared.rows.withColumn("_v", vector_to_array("scaled")).withColumn(
        "contributions", shares).withColumn("base", F.lit(base)).drop("_v")


def tree_paths(model) -> list[list[tuple]]:
    """Per leaf of every tree: (weighted value, [(feature, low, high, cover share), ...]).

    The model's node table is read back from its saved form in one scan. Conditions on the same
    feature along a path merge into one interval.
    """
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    ensure_checkpoint_dir(session)
    path = f"{session.sparkContext.getCheckpointDir()}/trees-{model.uid}"
    model.write().overwrite().save(path)
    table = session.read.parquet(f"{path}/data")
    nodes = table.select("treeID", "nodeData.*").select(
        "treeID", "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("f"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"), F.get("impurityStats", F.lit(0)).alias("cover"),
    ).toPandas()  # the model itself: trees x nodes per tree
    weights = model.treeWeights
    leaves = []
    for tree, part in nodes.groupby("treeID"):
        by_id = {int(r.id): r for r in part.itertuples()}

        def walk(node_id: int, seen: dict):
            node = by_id[node_id]
            if node.leftChild < 0:
                leaves.append((weights[int(tree)] * node.prediction,
                               [(f, lo, hi, z) for f, (lo, hi, z) in seen.items()]))
                return
            f = int(node.f)
            low, high, share = seen.get(f, (-math.inf, math.inf, 1.0))
            for child, lo, hi in ((int(node.leftChild), low, min(high, node.cut)),
                                  (int(node.rightChild), max(low, node.cut), high)):
                walk(child, {**seen, f: (lo, hi, share * by_id[child].cover / node.cover)})

        walk(0, {})
    return leaves


def leaf_contributions(value: float, shares: np.ndarray, holds: np.ndarray) -> np.ndarray:
    """Contributions of one leaf's features, a row for each pattern of conditions that hold.

    In the sum over feature subsets a known feature holds (1/0), an unknown one is averaged (its cover share). The weight of a
    subset of size k among m - 1 others is the integral of t^k (1 - t)^(m - 1 - k) over [0, 1]. So the weighted sum of products
    is the integral of one product of linear factors, the path extended by every feature but one: the product over the
    whole path, unwound by that feature's factor. Its degree is m - 1, for which Gauss-Legendre with m/2 nodes is exact.
    """
    m = len(shares)
    nodes, weights = np.polynomial.legendre.leggauss(m // 2 + 1)
    out = np.zeros(holds.shape)
    for t, w in zip((nodes + 1) / 2, weights / 2):
        factors = holds * t + shares * (1 - t)  # never 0: shares are positive
        out += w * factors.prod(axis=1, keepdims=True) / factors
    return value * (holds - shares) * out


def path_contributions(rows: DataFrame, leaves: list[tuple], features: str, width: int) -> DataFrame:
    """Adds ``contributions`` and ``base`` for a model given by the paths to its leaves (as ``tree_paths`` returns them)."""
    base = float(sum(v * math.prod(z for *_, z in path) for v, path in leaves))
    held = [(value, *(np.array(c) for c in zip(*path))) for value, path in leaves if path]
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def shapley(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # Rows with the same conditions holding have the same contributions: of a short path all patterns are worked out once.
        known = [_all_patterns(value, shares) if len(at) <= TABLE_FEATURES else None for value, at, _, _, shares in shared.value]
        for batch in batches:
            x = np.stack(batch.to_numpy()).astype(float).reshape(-1, width).T.copy()
            out = np.zeros_like(x)
            for (value, at, low, high, shares), table in zip(shared.value, known):
                code = np.zeros(x.shape[1], dtype=np.int64)
                for j, f in enumerate(at):
                    holds = x[f] <= high[j] if low[j] == -np.inf else x[f] > low[j] if high[j] == np.inf else (x[f] > low[j]) & (x[f] <= high[j])
                    code += holds.astype(np.int64) << j
                if table is None:
                    patterns, code = np.unique(code, return_inverse=True)
                    table = leaf_contributions(value, shares, _holding(patterns, len(at))).T
                for j, f in enumerate(at):
                    out[f] += table[j][code]
            yield pd.Series(list(out.T.copy()))

    udf = F.pandas_udf(shapley, ArrayType(DoubleType()))
    return rows.withColumn("contributions", udf(F.col(features))).withColumn("base", F.lit(base))


def _holding(patterns: np.ndarray, features: int) -> np.ndarray:
    return (patterns[:, None] >> np.arange(features, dtype=np.int64) & 1).astype(float)


def _all_patterns(value: float, shares: np.ndarray) -> np.ndarray:
    """Contributions (feature, pattern) of one leaf for every pattern of conditions."""
    return leaf_contributions(value, shares, _holding(np.arange(1 << len(shares)), len(shares))).T.copy()


def tree_contributions(rows: DataFrame, model, features: str = "plain") -> DataFrame:
    """Adds ``contributions`` and ``base``; base + sum = the ensemble's margin."""
    known = rows.withColumn("_x", vector_to_array(features))
    return path_contributions(known, tree_paths(model), "_x", model.numFeatures).drop("_x")


def global_importance(contributed: DataFrame, names: list[str], top_n: int = 15) -> DataFrame:
    """Features by mean absolute contribution."""
    means = contributed.agg(F.array(*[F.avg(F.abs(F.col("contributions")[i])) for i in range(len(names))]).alias("m"))
    labels = F.array(*[F.lit(n) for n in names])
    return means.select(F.inline(F.arrays_zip(labels.alias("feature"), F.col("m").alias("mean_abs_contribution")))).orderBy(
        F.col("mean_abs_contribution").desc(), "feature").limit(top_n)


def top_contributors(contributed: DataFrame, names: list[str], top_n: int = 6, features: str = "plain") -> DataFrame:
    """Per row the features with the largest absolute contribution: signed, with the feature's value; and the margin."""
    labels = F.array(*[F.lit(n) for n in names])
    ranked = F.reverse(F.array_sort(F.transform(
        F.arrays_zip(labels.alias("feature"), F.col("contributions").alias("c"), vector_to_array(features).alias("v")),
        lambda z: F.struct(F.abs(z["c"]).alias("size"), z["feature"].alias("feature"), F.round(z["c"], 4).alias("contribution"),
                           z["v"].alias("value")))))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)
    return contributed.select(
        "transaction_id", "split", "base", (F.col("base") + total).alias("predicted_margin"),
        F.transform(F.slice(ranked, 1, top_n), lambda s: F.struct(s["feature"], s["contribution"], s["value"])).alias("top_contributors"))
