"""Distances, bearings and the gnomonic map as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0      # fixed value: great-circle distances
PROJECTION_RADIUS_KM = 6378.137  # fixed value: equatorial radius used by the map projection


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; the root is clamped so antipodes stay inside asin's domain."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing from point 1 to point 2, 0 = north, 90 = east, below 360."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = (F.cos(F.radians(lat1)) * F.sin(F.radians(lat2))
         - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon))
    return F.pmod(F.degrees(F.atan2(y, x)) + F.lit(360.0), F.lit(360.0))


def gnomonic_xy(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Kilometres east and north of the centre on the tangent plane."""
    phi, phi0, dlon = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    cos_c = F.sin(phi0) * F.sin(phi) + F.cos(phi0) * F.cos(phi) * F.cos(dlon)
    x = F.lit(PROJECTION_RADIUS_KM) * F.cos(phi) * F.sin(dlon) / cos_c
    y = (F.lit(PROJECTION_RADIUS_KM)
         * (F.cos(phi0) * F.sin(phi) - F.sin(phi0) * F.cos(phi) * F.cos(dlon)) / cos_c)
    return x, y


def gnomonic_lonlat(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Inverse of ``gnomonic_xy``."""
    phi0 = F.radians(lat0)
    rho = F.sqrt(x * x + y * y)
    c = F.atan(rho / F.lit(PROJECTION_RADIUS_KM))
    safe_rho = F.when(rho == 0, F.lit(1.0)).otherwise(rho)
    lat = F.degrees(F.asin(F.cos(c) * F.sin(phi0) + y * F.sin(c) * F.cos(phi0) / safe_rho))
    lon = lon0 + F.degrees(F.atan2(x * F.sin(c), rho * F.cos(phi0) * F.cos(c) - y * F.sin(phi0) * F.sin(c)))
    return F.when(rho == 0, lon0).otherwise(lon), F.when(rho == 0, lat0).otherwise(lat)


def gnomonic_pixel(lon: Column, lat: Column, center: tuple[float, float] = (10.6, 56.1),
                   half_km: float = 260.0, res_km: float = 1.0, margin: int = 2) -> dict[str, Column]:
    """Row and column on a square grid (row 0 = north) and whether the point lies inside it."""
    n = int(2 * half_km / res_km)
    x, y = gnomonic_xy(lon, lat, F.lit(center[0]), F.lit(center[1]))
    col = F.floor((x + F.lit(half_km)) / F.lit(res_km)).cast("long")
    row = F.lit(n - 1) - F.floor((y + F.lit(half_km)) / F.lit(res_km)).cast("long")
    inside = col.between(margin, n - margin - 1) & row.between(margin, n - margin - 1)
    return {"row": row, "col": col, "inside": inside}
