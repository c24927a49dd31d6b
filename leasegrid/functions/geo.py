"""Geographic column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EARTH_RADIUS_MILES, FAR_DEGREES, WEB_MERCATOR_HALF_WORLD


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in miles (R = 3959)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_MILES) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Same formula as SQL text (DuckDB and Spark SQL both accept it)."""
    return (
        f"(2 * {EARTH_RADIUS_MILES} * atan2(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)), "
        f"sqrt(1 - (pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


def unit_vector(lat, lon) -> tuple[Column, Column, Column]:
    """Point on the unit sphere.

    The chord between two such points, times R, never exceeds the great-circle
    distance, so each coordinate difference times R is a lower bound of the
    distance in miles. Spatial grid joins use this bound to stay exact.
    """
    lat, lon = _c(lat), _c(lon)
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def web_mercator(lon, lat) -> tuple[Column, Column]:
    """WGS84 degrees -> Web Mercator metres (x, y)."""
    lon, lat = _c(lon), _c(lat)
    x = lon * F.lit(WEB_MERCATOR_HALF_WORLD) / F.lit(180.0)
    y = F.ln(F.tan((F.lit(90.0) + lat) * F.lit(math.pi) / F.lit(360.0))) / F.lit(math.pi / 180.0)
    return x, y * F.lit(WEB_MERCATOR_HALF_WORLD) / F.lit(180.0)


def direction_from_center(lat, lon, center_lat, center_lon) -> Column:
    """Cardinal direction of a point from a centre, with ``Far `` beyond 0.05 degrees."""
    dlat = _c(lat) - _c(center_lat)
    dlon = _c(lon) - _c(center_lon)
    base = (
        F.when(F.abs(dlat) > F.abs(dlon), F.when(dlat > 0, F.lit("North")).otherwise(F.lit("South")))
        .otherwise(F.when(dlon > 0, F.lit("East")).otherwise(F.lit("West")))
    )
    dist = F.sqrt(dlat * dlat + dlon * dlon)
    return F.when(dist > F.lit(FAR_DEGREES), F.concat(F.lit("Far "), base)).otherwise(base)


def squared_degrees(lat1, lon1, lat2, lon2) -> Column:
    """Squared Euclidean distance in degrees (nearest-centroid metric)."""
    dlat = _c(lat1) - _c(lat2)
    dlon = _c(lon1) - _c(lon2)
    return dlat * dlat + dlon * dlon
