"""Great-circle distance and implied travel speed as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0  # fixed value


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(chord, F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)


def implied_speed_kmh(lat1: Column, lon1: Column, lat2: Column, lon2: Column, hours: Column) -> Column:
    """Infinite when no time passed."""
    return F.when(hours <= 0, F.lit(float("inf"))).otherwise(haversine_km(lat1, lon1, lat2, lon2) / hours)
