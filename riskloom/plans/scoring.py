"""Combined risk score: four components, weighted sum, tiers from validation quantiles."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import clamp01, combined_score, exposure_component, noisy_or, risk_tier, rules_component
from riskloom.operators.quantile_cut import exact_quantiles

# Fixed values.
EXPOSURE_CAP_QUANTILE = 0.95
TIER_QUANTILES = {"CRITICAL": 0.99, "HIGH": 0.95, "MEDIUM": 0.80}


@dataclass(frozen=True)
class ScoringConstants:
    """What the job learns from data: the train-period amount cap and the validation cut-offs."""

    exposure_cap: float
    tier_cutpoints: Mapping[str, float]


def fit_exposure_cap(matrix: DataFrame) -> float:
    train = matrix.filter("split = 'train'")
    return exact_quantiles(train, ["amount"], [EXPOSURE_CAP_QUANTILE])["amount"][0]


def with_components(matrix: DataFrame, cap: float, ml: Column, forest: Column) -> DataFrame:
    """Adds the four components and the unrounded combined score."""
    df = matrix.select(
        "*",
        ml.cast("double").alias("ml_component"),
        rules_component(F.col("max_rule_severity"), F.col("rules_fired_count")).alias("rules_component"),
        noisy_or(clamp01(F.col("behavioral_anomaly_score")), clamp01(forest)).alias("behavioral_component"),
        exposure_component(F.col("amount"), F.lit(cap)).alias("exposure_component"))
    return df.withColumn("raw_score", combined_score(
        F.col("ml_component"), F.col("rules_component"), F.col("behavioral_component"), F.col("exposure_component")))


def fit_tier_cutpoints(scored: DataFrame) -> dict[str, float]:
    cuts = exact_quantiles(
        scored.filter("split = 'validation'"), ["raw_score"], list(TIER_QUANTILES.values()))["raw_score"]
    return dict(zip(TIER_QUANTILES, cuts))


def with_tiers(scored: DataFrame, cuts: Mapping[str, float]) -> DataFrame:
    """Tier of the unrounded score; then the stored precision."""
    parts = ["ml_component", "rules_component", "behavioral_component", "exposure_component"]
    out = scored.withColumn("risk_tier", risk_tier(F.col("raw_score"), cuts)).withColumn("combined_score", F.bround("raw_score", 5))
    return out.withColumns({p: F.bround(p, 5) for p in parts})


def score_transactions(matrix: DataFrame, ml: Column, forest: Column) -> tuple[DataFrame, ScoringConstants]:
    """``matrix`` needs a ``split`` column; ``ml`` and ``forest`` are the pluggable model scores.

    Tiers come from the unrounded score; stored values have five digits, half to even.
    """
    cap = fit_exposure_cap(matrix)
    scored = with_components(matrix, cap, ml, forest)
    cuts = fit_tier_cutpoints(scored)
    return with_tiers(scored, cuts).withColumn("ml_in_sample", F.col("split") == "train"), ScoringConstants(cap, cuts)


def risk_scores(scored: DataFrame) -> DataFrame:
    """The stored table's columns."""
    return scored.select(
        "transaction_id", "ml_component", "rules_component", "behavioral_component", "exposure_component",
        "combined_score", "risk_tier")


def tier_fraud_check(scored: DataFrame) -> DataFrame:
    return scored.groupBy("risk_tier").agg(
        F.avg(F.col("is_fraud").cast("int")).alias("fraud_rate"), F.count("*").alias("n"))
