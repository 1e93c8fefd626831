"""Scalar expressions against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom import functions as fn
from riskloom.operators.slices import floor_div


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def lit(x):
    return F.lit(x).cast("double")


def test_haversine(spark):
    nyc, london = (40.7128, -74.0060), (51.5074, -0.1278)
    there = one(spark, fn.haversine_km(*map(lit, nyc), *map(lit, london)))
    back = one(spark, fn.haversine_km(*map(lit, london), *map(lit, nyc)))
    assert 5500 < there < 5620 and there == pytest.approx(back)
    assert one(spark, fn.haversine_km(*map(lit, nyc), *map(lit, nyc))) == 0
    assert one(spark, fn.haversine_km(lit(0), lit(0), lit(0), lit(180))) == pytest.approx(math.pi * 6371.0)


def test_speed_without_elapsed_time_is_infinite(spark):
    for hours in (0.0, -1.0):
        assert one(spark, fn.implied_speed_kmh(lit(0), lit(0), lit(1), lit(1), lit(hours))) == math.inf


@pytest.mark.parametrize("actual,threshold,expected", [
    (2, 1, "CRITICAL"), (1.99, 1, "HIGH"), (1.5, 1, "HIGH"), (1.0, 1, "MEDIUM"), (0.5, 1, "LOW"), (5, 0, "MEDIUM")])
def test_severity(spark, actual, threshold, expected):
    assert one(spark, fn.severity_for_ratio(lit(actual), threshold)) == expected


@pytest.mark.parametrize("amount,q1,q3,n,expected", [
    (50, 20, 40, 10, 0), (100, 20, 40, 10, 1.5), (305.74, 114.5, 114.5, 3, 0), (100, 50, 50, 10, 0), (100, 20, 40, 9, 0)])
def test_iqr(spark, amount, q1, q3, n, expected):
    assert one(spark, fn.iqr_upper_outlier(lit(amount), lit(q1), lit(q3), F.lit(n))) == pytest.approx(expected)


def test_iqr_without_history_is_zero(spark):
    null = F.lit(None).cast("double")
    assert one(spark, fn.iqr_upper_outlier(lit(5), null, null, null)) == 0


@pytest.mark.parametrize("z,expected", [(0, 0), (1.5, 0.5), (3, 1), (5, 1), (-2, 0), (None, 0)])
def test_normalize_z(spark, z, expected):
    assert one(spark, fn.normalize_z(lit(z))) == expected


def test_poisson_z(spark):
    z = fn.poisson_frequency_z(lit(14), lit(90), lit(90))
    assert one(spark, z) == pytest.approx((14 - 7) / math.sqrt(7))
    assert one(spark, fn.poisson_frequency_z(lit(14), lit(14), lit(14))) is None  # thin history
    assert one(spark, fn.poisson_frequency_z(lit(0), lit(15), lit(200))) == pytest.approx(
        (0 - 15 / 90 * 7) / math.sqrt(15 / 90 * 7))  # active days capped at 90
    assert one(spark, fn.poisson_frequency_z(lit(5), lit(20), lit(None))) is None


@pytest.mark.parametrize("severity,fired,expected", [
    (-1, 0, 0), (0, 1, 0.25), (1, 1, 0.5), (2, 1, 0.75), (3, 1, 1.0), (3, 10, 1.0), (0, 10, 0.45), (1, 2, 0.55)])
def test_rules_component(spark, severity, fired, expected):
    assert one(spark, fn.rules_component(F.lit(severity), F.lit(fired))) == pytest.approx(expected)


@pytest.mark.parametrize("a,b,expected", [(0, 0, 0), (1, 0, 1), (0.5, 0.5, 0.75), (7, -3, 1)])
def test_behavioral_component(spark, a, b, expected):
    assert one(spark, fn.noisy_or(fn.clamp01(lit(a)), fn.clamp01(lit(b)))) == expected


def test_weights_sum_to_one(spark):
    assert one(spark, fn.combined_score(lit(1), lit(1), lit(1), lit(1))) == pytest.approx(1.0)


def test_tiers(spark):
    cuts = {"CRITICAL": 0.8, "HIGH": 0.5, "MEDIUM": 0.2}
    tiers = [one(spark, fn.risk_tier(lit(s), cuts)) for s in (0.9, 0.8, 0.6, 0.5, 0.3, 0.2, 0.1)]
    assert tiers == ["CRITICAL", "CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]


def test_floor_div_below_zero(spark):
    assert [one(spark, floor_div(F.lit(v), 10)) for v in (-11, -10, -1, 0, 9, 10)] == [-2, -1, -1, 0, 0, 1]
