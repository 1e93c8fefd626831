"""Toxicity with a counterfactually regularised linear classifier.

Features of a text are its distinct words (lower-cased runs of letters) and the distinct beginnings of 4 to 7 letters
of its longer words. Counts of features by label, over all training rows, select the features; weights minimise the
logistic loss plus a penalty on the squared change of the score when identity terms of a sentence are swapped for
their counterparts, so that a neutral mention of a group does not move the score.

The classifier is fitted on at most ``MAX_TRAIN`` labelled rows, those with the smallest hash of their id; every
text is scored, whole. A null or empty text has no features and gets the base score. Label null teaches nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from riskloom.llm.common import append_columns, hash_sample

MAX_TRAIN = 20_000
MAX_FEATURES = 4_096
MIN_ROWS = 4
#: Least chi-squared of a feature against the label.
MIN_CHI = 20.0
STARTS = (4, 5, 6, 7)
THRESHOLD = 0.3
#: Distinct words a task remembers before it starts over.
WORDS_KEPT = 200_000

# Identity terms and their counterparts, swapped both ways.
IDENTITY_SWAPS = {
    "men": "women", "women": "men", "man": "woman", "woman": "man", "male": "female", "female": "male",
    "boy": "girl", "girl": "boy", "muslim": "christian", "christian": "jewish", "jewish": "muslim",
    "muslims": "christians", "christians": "jews", "jews": "muslims", "black": "white", "white": "black",
    "asian": "european", "european": "african", "african": "asian", "gay": "straight", "straight": "gay",
    "lesbian": "heterosexual", "heterosexual": "lesbian", "immigrant": "native", "native": "immigrant",
    "disabled": "abled", "abled": "disabled", "old": "young", "young": "old",
    "frauen": "männer", "männer": "frauen", "muslime": "christen", "christen": "muslime", "juden": "christen",
    "femmes": "hommes", "hommes": "femmes", "musulmans": "chrétiens", "chrétiens": "musulmans", "juifs": "chrétiens",
    "mujeres": "hombres", "hombres": "mujeres", "musulmanes": "cristianos", "cristianos": "musulmanes",
}

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STARTS if len(word) > n)]


def features(found: set[str]) -> set[str]:
    return {f for w in found for f in word_features(w)}


@dataclass
class Model:
    """Weights by feature, and the base score's logit."""

    weights: dict[str, float]
    bias: float


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _sparse(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([i for r in rows for i in r], dtype=np.int64)


def minimise(rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], n_features: int,
             penalty: float, l2: float = 5e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Full-gradient Adam on logistic loss + l2 + penalty * mean (score(original) - score(swapped))^2."""
    row, col = _sparse(rows)
    p_row, p_col = _sparse([a for a, _ in pairs])
    q_row, q_col = _sparse([b for _, b in pairs])
    w, bias = np.zeros(n_features), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        p = _sigmoid(np.bincount(row, w[col], minlength=len(rows)) + bias)
        error = (p - labels) / len(rows)
        gradient = np.bincount(col, error[row], minlength=n_features) + l2 * w
        base = error.sum()
        if pairs:
            a = _sigmoid(np.bincount(p_row, w[p_col], minlength=len(pairs)) + bias)
            b = _sigmoid(np.bincount(q_row, w[q_col], minlength=len(pairs)) + bias)
            change = 2 * penalty * (a - b) / len(pairs)
            da, db = change * a * (1 - a), change * b * (1 - b)
            gradient += np.bincount(p_col, da[p_row], minlength=n_features) - np.bincount(q_col, db[q_row], minlength=n_features)
            base += da.sum() - db.sum()
        g = np.append(gradient, base)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def fit(docs: DataFrame, id_column: str, text: str, labels: DataFrame, label_id: str, label: str, penalty: float = 1.0,
        max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, swaps: dict[str, str] | None = None) -> Model:
    """Fit on the labelled rows of ``docs``. What reaches the driver is bounded by max_train and max_features.

    The sample of labels is drawn first, so that at most max_train ids meet the documents (by broadcast).
    """
    swaps = IDENTITY_SWAPS if swaps is None else swaps
    drawn = (labels.select(F.col(label_id).alias("__id"), F.col(label).cast("int").alias("label"))
             .filter("label is not null and __id is not null"))
    drawn = hash_sample(drawn, ["__id", "label"], max_train)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    sample = rows.join(F.broadcast(drawn), F.col("id") == F.col("__id")).select("text", "label")

    def count(batches):
        counts: dict[tuple[str, int], int] = {}
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in features(words(t)):
                    counts[f, y] = counts.get((f, y), 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()),
             pa.array(list(counts.values()), pa.int64())], names=["feature", "label", "n"])

    sample = sample.persist()
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        sample.unpersist()
        return Model({}, float(np.log((pos + 1) / (neg + 1))))
    counted = (sample.mapInArrow(count, StructType([StructField("feature", StringType()), StructField("label", IntegerType()), StructField("n", LongType())]))
               .groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"),
                                       F.sum(F.when(F.col("label") != 1, F.col("n")).otherwise(0)).alias("b"))
               .filter(F.col("a") + F.col("b") >= MIN_ROWS))
    n, share = F.col("a") + F.col("b"), pos / (pos + neg)
    chi = F.pow(F.col("a") - n * share, 2) / (n * share * (1 - share))
    chosen = counted.filter(chi >= MIN_CHI).orderBy(chi.desc(), "feature").limit(max_features).collect()
    number = {r["feature"]: i for i, r in enumerate(chosen)}

    def vectorise(batches):
        for batch in batches:
            own, other = [], []
            for t in batch.column(0).to_pylist():
                found = words(t)
                own.append(sorted(number[f] for f in features(found) if f in number))
                swapped = {swaps.get(w, w) for w in found}
                other.append(None if swapped == found else sorted(number[f] for f in features(swapped) if f in number))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))],
                names=["label", "own", "swapped"])

    ints = ArrayType(IntegerType())
    rows = sample.mapInArrow(vectorise, StructType([StructField("label", IntegerType()), StructField("own", ints), StructField("swapped", ints)])).toArrow()
    sample.unpersist()
    own, swapped = rows.column("own").to_pylist(), rows.column("swapped").to_pylist()
    labels = (rows.column("label").to_numpy() == 1).astype(float)
    pairs = [(a, b) for a, b in zip(own, swapped) if b is not None]
    w, bias = minimise(own, labels, pairs, len(number), penalty)
    return Model({f: float(w[i]) for f, i in number.items()}, bias)


def score(df: DataFrame, text: str, model: Model, out: str = "score") -> DataFrame:
    """Rows pass through whole, with ``out``: the probability of label 1."""
    weights, bias = model.weights, model.bias

    def make():
        known: dict[str, tuple] = {}

        def work(texts):
            if len(known) > WORDS_KEPT:
                known.clear()
            scores = []
            for t in texts:
                used: dict[str, float] = {}
                for w in words(t):
                    hits = known.get(w)
                    if hits is None:
                        hits = known[w] = tuple((f, weights[f]) for f in word_features(w) if f in weights)
                    if hits:
                        used.update(hits)
                scores.append(bias + sum(used.values()))
            return [pa.array(_sigmoid(np.array(scores, dtype=np.float64)))]

        return work

    return append_columns(df, text, StructType([StructField(out, DoubleType())]), make)
