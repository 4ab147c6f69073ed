"""Registered jobs: candidate sites around every plant."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgate.functions.geo import EARTH_KM, haversine_sql
from airgate.operators import emissions, pathway, sitesearch
from airgate.plans.base import registered, shown
from airgate.plans.permit import _worst
from airgate.sources import derived
from airgate.sources.derived import SQL

_RADIUS, _N = 15.0, 24
#: What tells plants apart: a few share an id, not a design.
_PLANT = ("plant_id", "mw", "fuel", "enforceable", "run_hours")
_KEY = ", ".join(_PLANT)
_RING_ROWS = ", ".join(f"({km}::DOUBLE, {i})" for i, km in enumerate(sitesearch.rings_from(_RADIUS)))
_POINTS = f"""arcs AS (SELECT site_id AS origin, lat, lon, km AS ring_km, (k * 60 + 60 * i / 4.0::DOUBLE) AS bearing, (i * 6 + k + 1)::INT AS seq
  FROM sites, (VALUES {_RING_ROWS}) AS r(km, i), (SELECT unnest(range(0, 6)) AS k)),
turned AS (SELECT *, asin(sin(radians(lat)) * cos(ring_km / {EARTH_KM}::DOUBLE) + cos(radians(lat)) * sin(ring_km / {EARTH_KM}::DOUBLE) * cos(radians(bearing))) AS to_lat FROM arcs WHERE seq <= {_N}),
points AS (SELECT *, degrees(to_lat) AS plat, ((lon + degrees(atan2(sin(radians(bearing)) * sin(ring_km / {EARTH_KM}::DOUBLE) * cos(radians(lat)), cos(ring_km / {EARTH_KM}::DOUBLE) - sin(radians(lat)) * sin(to_lat))) + 540) % 360) - 180 AS plon FROM turned)"""
_SNAPPED = f"""{_POINTS}, reached AS (SELECT p.origin, p.seq, s.site_id AS parcel, {haversine_sql('p.plat', 'p.plon', 's.lat', 's.lon')} AS off,
  {haversine_sql('p.lat', 'p.lon', 'p.plat', 'p.plon')} AS km, p.bearing FROM points p, sites s WHERE abs(p.plat - s.lat) < 2),
snapped AS (SELECT *, row_number() OVER (PARTITION BY origin, seq ORDER BY round(off, 6), parcel) AS near FROM reached WHERE off <= 160),
candidates AS (SELECT origin, seq, parcel, km, bearing FROM snapped WHERE near = 1 UNION ALL SELECT site_id, 0, site_id, 0, 0 FROM sites)"""
_SEARCH = f"""WITH {SQL['plants']}, {SQL['sites']}, {SQL['designations']}, {emissions.sql()}, {_SNAPPED},
chosen AS (SELECT pte.*, origin, seq, parcel, km, bearing FROM pte JOIN candidates ON l_suppkey = origin), {pathway.sql('chosen.parcel = located.site_id')},
based AS (SELECT {_KEY}, seq, parcel, km, rank, months_likely, n_stops, max(CASE WHEN seq = 0 THEN rank END) OVER (PARTITION BY {_KEY}) - rank AS rank_delta,
  max(CASE WHEN seq = 0 THEN months_likely END) OVER (PARTITION BY {_KEY}) - months_likely AS months_saved FROM decided),
halted AS (SELECT *, min(CASE WHEN seq > 0 AND n_stops = 0 AND rank <= 1 AND rank_delta > 0 THEN seq END) OVER (PARTITION BY {_KEY}) AS stop_at FROM based),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY (n_stops > 0)::INT, rank, months_likely, round(km, 6), seq) AS place
  FROM halted WHERE seq > 0 AND seq <= coalesce(stop_at, seq))"""


def _candidates(spark, sf_dir):
    sites = derived.sites(spark, sf_dir)
    return sitesearch.candidate_parcels(sites, sites, _RADIUS, _N)


def _tried(spark, sf_dir):
    """Every plant with the candidates around it; plants are designed once they have met them, as narrow rows."""
    located = pathway.with_overlay(derived.sites(spark, sf_dir)).join(_worst(spark, sf_dir), "fips", "left")
    li, places = derived.read(spark, sf_dir, "lineitem"), sitesearch.around(_candidates(spark, sf_dir), located)
    plants = sitesearch.of_kind(derived.designed(li.join(places, li.l_suppkey == places.origin), "kinds", "limits"))
    return sitesearch.tried(pathway.design_in_brief(emissions.estimate(plants)), *_PLANT)


@registered(f"""WITH {SQL['sites']}, {_POINTS} SELECT origin, seq, ring_km, bearing, round(plat + 1e-7::DOUBLE, 4) AS lat, round(plon + 1e-7::DOUBLE, 4) AS lon FROM points""")
def prj26_candidate_points(spark, sf_dir):
    points = sitesearch.ring_points(derived.sites(spark, sf_dir).select(F.col("site_id").alias("origin"), "lat", "lon"), _RADIUS, _N)
    return points.select("origin", "seq", "ring_km", "bearing", shown("plat").alias("lat"), shown("plon").alias("lon"))


@registered(f"""WITH {SQL['sites']}, {_SNAPPED} SELECT origin, seq, parcel, round(km + 1e-7::DOUBLE, 4) AS km, bearing::DOUBLE AS bearing FROM candidates""")
def join7_candidate_parcels(spark, sf_dir):
    return _candidates(spark, sf_dir).withColumn("km", shown("km"))


@registered(f"""{_SEARCH} SELECT plant_id, place::INT AS place, seq, parcel, round(km + 1e-7::DOUBLE, 4) AS km, rank, round(months_likely + 1e-7::DOUBLE, 4) AS months_likely, n_stops,
  rank_delta, round(months_saved + 1e-7::DOUBLE, 4) AS months_saved FROM ranked WHERE place <= 8""")
def win1_candidate_sites(spark, sf_dir):
    found = sitesearch.read_rows(_tried(spark, sf_dir), _PLANT, first=8)
    return found.select("plant_id", "place", "seq", "parcel", shown("km").alias("km"), "rank", shown("months_likely").alias("months_likely"), "n_stops", "rank_delta", shown("months_saved").alias("months_saved"))


@registered(f"""{_SEARCH}, told AS (SELECT plant_id, count(*)::BIGINT AS read, count(*) FILTER (WHERE n_stops = 0 AND (rank_delta > 0 OR months_saved > 1))::BIGINT AS improving,
  count(*) FILTER (WHERE n_stops > 0 AND (rank_delta > 0 OR months_saved > 1))::BIGINT AS blocked, bool_or(stop_at IS NOT NULL) AS stopped_early,
  arg_min({{'parcel': parcel, 'rank_delta': rank_delta, 'months_saved': months_saved}}, place) FILTER (WHERE n_stops = 0 AND (rank_delta > 0 OR months_saved > 1)) AS b FROM ranked GROUP BY {_KEY})
SELECT plant_id, read, improving, blocked, stopped_early, b.parcel AS best, b.rank_delta AS rank_delta, round(b.months_saved + 1e-7::DOUBLE, 4) AS months_saved FROM told""")
def flt6_site_outcomes(spark, sf_dir):
    return sitesearch.outcomes(_tried(spark, sf_dir), _PLANT).drop(*_PLANT[1:]).withColumn("months_saved", shown("months_saved"))
