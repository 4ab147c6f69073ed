"""Geodesy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: The sixteen points of the compass.
COMPASS = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Great-circle kilometres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(F.col(lon2) - F.col(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"2 * {EARTH_KM}::DOUBLE * asin(least(1.0::DOUBLE, sqrt({h})))"


def destination(lat: str, lon: str, bearing: Column, km: Column) -> tuple[Column, Column]:
    """Latitude and longitude (wrapped to -180..180) after km along a bearing in degrees."""
    a, arc, way = F.radians(lat), km / EARTH_KM, F.radians(bearing)
    to = F.asin(F.sin(a) * F.cos(arc) + F.cos(a) * F.sin(arc) * F.cos(way))
    east = F.atan2(F.sin(way) * F.sin(arc) * F.cos(a), F.cos(arc) - F.sin(a) * F.sin(to))
    return F.degrees(to), F.pmod(F.col(lon) + F.degrees(east) + 540, F.lit(360.0)) - 180


def compass(bearing: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), (F.floor(bearing / 22.5 + 0.5) % 16 + 1).cast("int"))
