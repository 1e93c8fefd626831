from riskloom.functions.geo import haversine_km, implied_speed_kmh
from riskloom.functions.scores import (
    amount_zscore, behavioral_anomaly, clamp01, combined_score, exposure_component, iqr_upper_outlier,
    noisy_or, normalize_z, poisson_frequency_z, risk_tier, rules_component, severity_for_ratio,
)

__all__ = [
    "haversine_km", "implied_speed_kmh", "amount_zscore", "behavioral_anomaly", "clamp01", "combined_score",
    "exposure_component", "iqr_upper_outlier", "noisy_or", "normalize_z", "poisson_frequency_z", "risk_tier",
    "rules_component", "severity_for_ratio",
]
