"""Scalar scoring expressions: severities, outlier scores, components, tiers.

``greatest``/``least`` skip nulls in Spark, so every expression says what a null means.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# Fixed values.
MIN_HISTORY_FOR_IQR = 10
MIN_HISTORY_FOR_FREQUENCY = 15
FREQUENCY_TRIGGER_Z = 3.0
COMPONENT_WEIGHTS = {"ml": 0.40, "rules": 0.20, "behavioral": 0.20, "exposure": 0.20}
SEVERITY_BASE_SCORE = {-1: 0.0, 0: 0.25, 1: 0.50, 2: 0.75, 3: 1.00}
EXTRA_RULE_BONUS = 0.05
EXTRA_RULE_BONUS_CAP = 0.20


def severity_for_ratio(actual: Column, threshold: float) -> Column:
    if threshold <= 0:
        return F.lit("MEDIUM")
    ratio = actual / F.lit(float(threshold))
    return (F.when(ratio >= 2.0, "CRITICAL").when(ratio >= 1.5, "HIGH")
            .when(ratio >= 1.0, "MEDIUM").otherwise("LOW"))


def severity_ordinal(severity: Column) -> Column:
    return (F.when(severity == "LOW", 0).when(severity == "MEDIUM", 1)
            .when(severity == "HIGH", 2).when(severity == "CRITICAL", 3))


def amount_zscore(amount: Column, mean: Column, stddev: Column) -> Column:
    """Null when the deviation is unknown or zero."""
    return F.when(stddev > 0, (amount - mean) / stddev)


def iqr_upper_outlier(amount: Column, q1: Column, q3: Column, prior_count: Column) -> Column:
    """IQR widths beyond the upper Tukey fence; 0 inside it, on a flat or thin history."""
    iqr = q3 - q1
    trusted = (iqr > 0) & (prior_count >= MIN_HISTORY_FOR_IQR)
    beyond = (amount - (q3 + 1.5 * iqr)) / iqr
    return F.when(trusted & (beyond > 0), beyond).otherwise(0.0)


def poisson_frequency_z(count_7d: Column, count_90d: Column, active_days: Column) -> Column:
    """Weekly count against the long-run rate; null where the rate is not trustworthy."""
    days = F.least(F.greatest(active_days, F.lit(1.0)), F.lit(90.0))
    expected = count_90d / days * 7
    trusted = (count_90d >= MIN_HISTORY_FOR_FREQUENCY) & (expected >= 1) & active_days.isNotNull()
    return F.when(trusted, (count_7d - expected) / F.sqrt(F.greatest(expected, F.lit(0.5))))


def clamp01(score: Column) -> Column:
    return F.when(score.isNotNull(), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def normalize_z(z: Column, trigger_z: float = FREQUENCY_TRIGGER_Z) -> Column:
    return F.coalesce(clamp01(z / trigger_z), F.lit(0.0))


def noisy_or(*scores: Column) -> Column:
    miss = F.lit(1.0)
    for score in scores:
        miss = miss * (1 - score)
    return 1 - miss


def behavioral_anomaly(customer_iqr: Column, merchant_iqr: Column, frequency_z: Column) -> Column:
    def share(score: Column) -> Column:
        return F.coalesce(F.least(score, F.lit(3.0)) / 3, F.lit(0.0))

    return noisy_or(share(customer_iqr), share(merchant_iqr), normalize_z(frequency_z))


def rules_component(max_severity: Column, rules_fired: Column) -> Column:
    base = F.lit(SEVERITY_BASE_SCORE[-1])
    for ordinal in (0, 1, 2, 3):
        base = F.when(max_severity == ordinal, SEVERITY_BASE_SCORE[ordinal]).otherwise(base)
    extra = F.least((rules_fired - 1) * EXTRA_RULE_BONUS, F.lit(EXTRA_RULE_BONUS_CAP))
    return F.least(base + F.when(rules_fired > 1, extra).otherwise(0.0), F.lit(1.0))


def exposure_component(amount: Column, cap: Column) -> Column:
    return F.least(amount / cap, F.lit(1.0))


def combined_score(ml: Column, rules: Column, behavioral: Column, exposure: Column) -> Column:
    w = COMPONENT_WEIGHTS
    return ml * w["ml"] + rules * w["rules"] + behavioral * w["behavioral"] + exposure * w["exposure"]


def risk_tier(score: Column, cutpoints: Mapping[str, float | Column]) -> Column:
    tier = F.when(score >= cutpoints["CRITICAL"], "CRITICAL")
    for name in ("HIGH", "MEDIUM"):
        tier = tier.when(score >= cutpoints[name], name)
    return tier.otherwise("LOW")
