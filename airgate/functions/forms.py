"""Forms of names, amounts, units, dates and coordinates as column expressions, and SQL functions of some of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def folded(name: Column) -> Column:
    """Lower case, & as and, st. as saint, no county suffix, runs of anything else as one space."""
    low = F.replace(F.lower(F.replace(name, F.lit("&"), F.lit(" and "))), F.lit("st. "), F.lit("saint "))
    return F.trim(F.regexp_replace(F.regexp_replace(low, " (county|parish|borough)$", ""), "[^a-z0-9]+", " "))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def usd_tier(v: Column) -> tuple[Column, Column]:
    """B, M, k or nothing, and the amount in that tier."""
    size = F.abs(v)
    tier = F.when(size >= 1e9, "B").when(size >= 1e6, "M").when(size >= 1e3, "k").otherwise("")
    return tier, v / F.when(size >= 1e9, 1e9).when(size >= 1e6, 1e6).when(size >= 1e3, 1e3).otherwise(1.0)


def kilometres(x: Column, unit: Column) -> Column:
    return x * F.when(unit == "km", 1.0).when(unit == "mi", 1.609344).when(unit == "m", 0.001).when(unit == "ft", 0.0003048)


def looked_up(key: Column, held: dict[str, float]) -> Column:
    """The value of a key; null for others."""
    out = F.lit(None).cast("double")
    for name, x in held.items():
        out = F.when(key == name, x).otherwise(out)
    return out


def schedule(day: Column, now: str, energised: str) -> tuple[Column, Column]:
    """Months from a day until now (a month has 30.4375 days), and whether the day lies before another."""
    to = lambda d: F.datediff(F.lit(d).cast("date"), day)
    return to(now) / 30.4375, to(energised) > 0


def utm_easting(lat: Column, lon: Column) -> tuple[Column, Column]:
    """UTM zone and easting of WGS84 coordinates, by the usual series."""
    e2 = 0.0066943799901413165
    prime = e2 / (1 - e2)
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    p, away = F.radians(lat), F.radians(lon - (F.floor((lon + 180) / 6) * 6 - 177))
    n = 6378137.0 / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    t, c, a = F.pow(F.tan(p), 2), prime * F.pow(F.cos(p), 2), away * F.cos(p)
    series = a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * prime) * F.pow(a, 5) / 120
    return zone, 500000 + 0.9996 * n * series


def register_sql(spark: SparkSession) -> None:
    """SQL functions that stay inside Catalyst."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION airgate_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN "
        "2 * 6371.0088D * asin(least(1.0D, sqrt(power(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * power(sin(radians(d - b) / 2), 2))))"
    )
    root = math.sqrt(2 * math.pi)
    tail = "0.319381530D + t * (-0.356563782D + t * (1.781477937D + t * (-1.821255978D + t * 1.330274429D)))"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION airgate_tail(z DOUBLE, t DOUBLE) RETURNS DOUBLE RETURN exp(-z * z / 2) / {root!r}D * t * ({tail})"
    )


def bare_county(name: Column) -> Column:
    return F.regexp_replace(name, " (County|Parish|Borough|city)$", "")


def state_kind(said: Column) -> Column:
    """How a state is given: by a FIPS prefix, by its two letters, or not at all."""
    return F.when(said.rlike("^[0-9]{2}"), "fips").when(said.rlike("^[A-Z]{2}$"), "code").otherwise("??")


def classification(said: Column) -> tuple[Column, Column]:
    """The class in a trailing parenthesis, and the pollutant that the text names."""
    low = F.lower(said)
    return F.lower(F.regexp_extract(said, r"\(([^)]*)\)\s*$", 1)), F.when(low.contains("ozone"), "ozone").when(low.contains("pm-2.5"), "pm25")


def untagged(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def coordinates(said: Column) -> tuple[Column, Column]:
    """Latitude and longitude of "lat, lon"; null for other text."""
    parts = F.split(said, ",")
    both = F.size(parts) == 2
    return F.when(both, F.trim(parts[0]).try_cast("double")), F.when(both, F.trim(F.get(parts, F.lit(1))).try_cast("double"))


def albers(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Albers' equal-area conic of the contiguous states, on the unit sphere."""
    low, high = math.radians(29.5), math.radians(45.5)
    n = (math.sin(low) + math.sin(high)) / 2
    k = math.cos(low) ** 2 + 2 * n * math.sin(low)
    rho, away = F.sqrt(k - 2 * n * F.sin(F.radians(lat))) / n, n * F.radians(lon + 96)
    return rho * F.sin(away), math.sqrt(k - 2 * n * math.sin(math.radians(37.5))) / n - rho * F.cos(away)


def unescaped(text: Column) -> Column:
    """The few character references that unit labels use."""
    for name, sign in (("&micro;", "µ"), ("&sup2;", "²"), ("&sup3;", "³"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text
