"""Distances."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skyledger import fixed_values as V


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * V.EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def arc_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the spherical law of cosines."""
    cosine = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2) - F.radians(lon1)) + F.sin(
        F.radians(lat1)
    ) * F.sin(F.radians(lat2))
    return F.lit(V.EARTH_RADIUS_KM) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def flat_metric(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared distance in degrees with shrunk longitudes."""
    dlat, dlon = lat2 - lat1, (lon2 - lon1) * V.LON_SHRINK
    return dlat * dlat + dlon * dlon
