"""Great-circle geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerwatch.config import EARTH_RADIUS_KM

# Widens the pre-filter box a little so rounding can never lose a point on its edge.
_SLACK_DEG = 1e-9


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance; null when a coordinate is."""
    dlat = F.radians(lat2) - F.radians(lat1)
    dlon = F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def lon_reach_deg(lat_deg: float, radius_km: float) -> float:
    """Largest longitude offset a circle around this latitude reaches."""
    ratio = math.sin(radius_km / EARTH_RADIUS_KM) / max(math.cos(math.radians(lat_deg)), 1e-12)
    return math.degrees(math.asin(ratio)) if ratio < 1 else 180.0


def within_radius(lat: Column, lon: Column, centre: tuple[float, float], radius_km: float) -> Column:
    """Inside the circle. The box on bare columns comes first, so it reaches the scan."""
    lat0, lon0 = centre
    dlat = math.degrees(radius_km / EARTH_RADIUS_KM) + _SLACK_DEG
    dlon = lon_reach_deg(lat0, radius_km) + _SLACK_DEG
    box = (lat >= lat0 - dlat) & (lat <= lat0 + dlat)
    if abs(lon0) + dlon <= 180.0:
        box = box & (lon >= lon0 - dlon) & (lon <= lon0 + dlon)
    near = distance_km(F.lit(lat0), F.lit(lon0), lat, lon) <= radius_km
    return F.coalesce(box & near, F.lit(False))
