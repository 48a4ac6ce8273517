"""Spherical distance and its bounding boxes as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean earth radius used by the spherical distance, in metres.
EARTH_RADIUS_M = 6371000.0

# Boxes are widened by this much so that rounding never drops a true match.
_SLACK = 1e-9


def _col(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def haversine_m(
    *, lat1: Column | float, lon1: Column | float, lat2: Column | float, lon2: Column | float
) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    dlat = F.sin(F.radians(_col(lat2) - _col(lat1)) / 2.0)
    dlon = F.sin(F.radians(_col(lon2) - _col(lon1)) / 2.0)
    a = dlat * dlat + F.cos(p1) * F.cos(p2) * dlon * dlon
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def circle_span(*, lat: float, radius_m: float) -> tuple[float, float, float]:
    """``(min_lat, max_lat, half_lon)`` of a circle; ``half_lon`` is 180 when a pole is inside."""
    arc = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + _SLACK) + _SLACK
    if lat + arc >= 90.0 or lat - arc <= -90.0:
        return max(lat - arc, -90.0), min(lat + arc, 90.0), 180.0
    ratio = math.sin(math.radians(arc)) / math.cos(math.radians(lat))
    half = 180.0 if ratio >= 1.0 else math.degrees(math.asin(ratio)) * (1 + _SLACK) + _SLACK
    return lat - arc, lat + arc, min(half, 180.0)


def circle_span_columns(*, lat: Column, radius_m: Column) -> tuple[Column, Column, Column]:
    """Column form of :func:`circle_span`."""
    arc = F.degrees(radius_m / EARTH_RADIUS_M) * (1 + _SLACK) + _SLACK
    polar = (lat + arc >= 90.0) | (lat - arc <= -90.0)
    ratio = F.sin(F.radians(arc)) / F.cos(F.radians(lat))
    half = F.degrees(F.asin(F.least(F.lit(1.0), ratio))) * (1 + _SLACK) + _SLACK
    half = F.when(polar | (ratio >= 1.0), 180.0).otherwise(F.least(half, F.lit(180.0)))
    return F.greatest(lat - arc, F.lit(-90.0)), F.least(lat + arc, F.lit(90.0)), half


def fold_longitude_sql(lon: str) -> str:
    """SQL text for a longitude in [-180, 180]; values already inside are kept bit for bit."""
    return (f"(CASE WHEN {lon} BETWEEN -180D AND 180D THEN {lon} "
            f"ELSE pmod({lon} + 180D, 360D) - 180D END)")


def fold_longitude(lon: Column) -> Column:
    """Column form of :func:`fold_longitude_sql`."""
    return F.when(lon.between(-180.0, 180.0), lon).otherwise(
        F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    )
