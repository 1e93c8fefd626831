"""Model inputs: imputation, one-hot, scaling. Constants come from the training split only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.operators.quantile_cut import exact_quantiles
from riskloom.plans.matrix import BOOLEAN, CATEGORICAL, NUMERIC

#: A categorical column is a closed vocabulary: its values become columns and travel through the driver.
MAX_CATEGORIES = 1_000


@dataclass(frozen=True)
class Preprocessor:
    """Frozen train-period constants; ``names`` lists the encoded features in order."""

    numeric: list[str]
    medians: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]
    categories: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return self.numeric + BOOLEAN + [f"{c}_{v}" for c in CATEGORICAL for v in self.categories[c]]

    def imputed(self, name: str) -> Column:
        value = F.col(name).cast("double")
        return F.coalesce(value, F.lit(self.medians[name])) if name in self.medians else value

    def columns(self, scaled: bool) -> list[Column]:
        """Unknown categories encode as all zeros; only numbers and flags are scaled."""
        out = []
        for name in self.numeric + BOOLEAN:
            value = self.imputed(name)
            out.append((value - self.mean[name]) / (self.std[name] or 1.0) if scaled else value)
        for c in CATEGORICAL:
            out += [F.coalesce(F.col(c) == v, F.lit(False)).cast("double") for v in self.categories[c]]
        return out

    def transform(self, df: DataFrame, scaled: bool, into: str = "features") -> DataFrame:
        return df.withColumn(into, array_to_vector(F.array(*self.columns(scaled))))


def fit_preprocessor(train: DataFrame, numeric: list[str] | None = None) -> Preprocessor:
    """Medians, then means, population deviations and category lists in one more aggregate."""
    numeric = numeric or NUMERIC
    cuts = exact_quantiles(train, numeric, [0.5])
    medians = {c: (v[0] if v and v[0] is not None else 0.0) for c, v in cuts.items()}
    draft = Preprocessor(numeric, medians, {}, {}, {})
    kinds = train.agg(*[F.approx_count_distinct(c).alias(c) for c in CATEGORICAL]).first()
    if crowded := [c for c in CATEGORICAL if kinds[c] > MAX_CATEGORIES]:
        raise ValueError(f"more than {MAX_CATEGORIES} values in {crowded}: not a closed vocabulary")
    stats = train.agg(
        *[F.avg(draft.imputed(c)).alias(f"m_{c}") for c in numeric + BOOLEAN],
        *[F.stddev_pop(draft.imputed(c)).alias(f"s_{c}") for c in numeric + BOOLEAN],
        *[F.array_sort(F.collect_set(c)).alias(f"c_{c}") for c in CATEGORICAL]).first()
    return Preprocessor(
        numeric, medians, {c: stats[f"m_{c}"] for c in numeric + BOOLEAN},
        {c: stats[f"s_{c}"] for c in numeric + BOOLEAN}, {c: list(stats[f"c_{c}"]) for c in CATEGORICAL})
