"""Candidate sites: points, the nearest parcel by growing radius, ranking and early stop, against plain versions."""

import math

import numpy as np
from pyspark.sql import functions as F

from airgate.operators import sitesearch


def km_between(a, b):
    (la, lo), (lb, lp) = [tuple(map(math.radians, x)) for x in (a, b)]
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def test_rings_start_at_the_radius():
    assert sitesearch.rings_from(15.0) == [15.0, 30.0, 60.0, 120.0]
    assert sitesearch.rings_from(20.0) == [20.0, 30.0, 60.0, 120.0]
    assert sitesearch.rings_from(500.0) == [500.0]


def test_points_lie_on_their_rings_with_bearings_of_their_own(spark):
    origins = spark.createDataFrame([(1, 38.9, -77.2), (2, 64.0, -179.9), (3, None, 5.0)], "origin long, lat double, lon double")
    rows = sitesearch.ring_points(origins).collect()
    assert len(rows) == 48 and {r["origin"] for r in rows} == {1, 2}
    for r in rows:
        assert abs(km_between((r["lat"], r["lon"]), (r["plat"], r["plon"])) - r["ring_km"]) < 1e-6 and -180 <= r["plon"] < 180
    one = sorted((r["seq"], r["ring_km"], r["bearing"]) for r in rows if r["origin"] == 1)
    assert [s for s, _, _ in one] == list(range(1, 25)) and len({b for _, _, b in one}) == 24
    assert [k for _, k, _ in one] == sorted(k for _, k, _ in one)
    few = sitesearch.ring_points(origins.where("origin = 1"), radius=20.0, n=10).orderBy("seq").collect()
    assert [r["ring_km"] for r in few] == [20.0] * 3 + [30.0] * 3 + [60.0] * 3 + [120.0]


def test_points_meet_their_nearest_parcel_however_far_it_is(spark):
    rng = np.random.default_rng(2)
    points = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(30, 42, 120), rng.uniform(-100, -85, 120), strict=True))]
    parcels = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(30, 40, 60), rng.uniform(-98, -88, 60), strict=True))]
    parcels += [(1000, *parcels[5][1:]), (-1, *parcels[6][1:])]  # ties go to the least id
    got = sitesearch.snapped(spark.createDataFrame(points, "site_id long, lat double, lon double"), spark.createDataFrame(parcels, "feature_id long, flat double, flon double"))
    want = {}
    for i, *at in points:
        d, j = min((round(km_between(at, p), 6), k) for k, *p in parcels)
        if d <= 160:
            want[i] = j
    assert {r["site_id"]: r["parcel"] for r in got.collect()} == want and 0 < len(want) < 120
    assert sitesearch.snapped(spark.createDataFrame(points, "site_id long, lat double, lon double").limit(0), spark.createDataFrame(parcels, "feature_id long, flat double, flon double")).count() == 0


def test_unread_points_are_no_candidates(spark):
    origins = spark.createDataFrame([(1, 40.0, -70.0), (2, 10.0, 10.0)], "site_id long, lat double, lon double")
    parcels = spark.createDataFrame([(7, 40.5, -70.0)], "site_id long, lat double, lon double")
    rows = sitesearch.candidate_parcels(origins, parcels).collect()
    assert sorted((r["origin"], r["parcel"]) for r in rows if r["seq"] == 0) == [(1, 1), (2, 2)]
    assert {r["origin"] for r in rows if r["seq"]} == {1} and {r["parcel"] for r in rows if r["seq"]} == {7}


def plants(spark, mw, fuel="natural_gas"):
    from airgate.operators import emissions

    rows = [("p", 1, mw, "combined_cycle_turbine", fuel, ["dry_low_nox", "scr"], 8760.0, False, None, 1)]
    held = "plant_id string, l_suppkey long, mw double, prime_mover string, fuel string, controls array<string>, run_hours double, enforceable boolean, heat_rate double, units int"
    return emissions.estimate(spark.createDataFrame(rows, held))


def located(spark, rows):
    from airgate.operators import pathway

    facts = "site_id long, state string, county string, moratorium boolean, zoning_posture string, gas_pipeline_km double, ozone_class string"
    held = spark.createDataFrame(rows, facts).withColumns({
        "residents_1km": F.lit(0), "terrain_relief_m": F.lit(0.0), "cases": F.lit(0), "class_i_km": F.lit(None).cast("double"), "increment_no2": F.lit(0.0), "increment_pm25": F.lit(0.0),
        **{f"{p}_class": F.lit(None).cast("string") for p in ("pm25", "pm10", "co", "so2", "no2", "lead")},
    })
    return pathway.with_overlay(held)


def candidates(spark, rows):
    return spark.createDataFrame([(1, s, p, float(k), 0.0) for s, p, k in rows], "origin long, seq int, parcel long, km double, bearing double")


SITES = [
    (1, "CA", "x", False, "by-right", 1.0, "extreme"),  # the origin: nonattainment review
    (2, "GA", "y", True, "by-right", 1.0, None),  # better, but under a moratorium
    (3, "CA", "z", False, "by-right", 1.0, "extreme"),
    (4, "GA", "w", False, "by-right", 1.0, None),  # better and clean
    (5, "GA", "v", False, "hostile", 1.0, None),  # as good, six months slower
]


def test_a_hard_stop_ranks_last_and_distance_breaks_ties(spark):
    found = sitesearch.searched(plants(spark, 500.0), candidates(spark, [(0, 1, 0), (1, 2, 1), (2, 4, 90), (3, 3, 2), (4, 4, 40), (5, 5, 3)]), located(spark, SITES))
    rows = {r["seq"]: r for r in found.collect()}
    assert [s for s, r in sorted(rows.items(), key=lambda x: x[1]["place"]) if r["kept"]] == [4, 2, 5, 1, 3] and not rows[0]["kept"]
    assert rows[1]["n_stops"] == rows[3]["n_stops"] == 1 and rows[1]["rank_delta"] == 1 and rows[3]["rank_delta"] == 0
    out = sitesearch.outcome(found).first()
    assert (out["read"], out["improving"], out["blocked"], out["best"], out["stopped_early"]) == (5, 3, 1, 4, False)


def test_the_search_stops_at_the_first_minor_site(spark):
    # A small plant is minor where the air is clean and major where it is not.
    found = sitesearch.searched(plants(spark, 36.0), candidates(spark, [(0, 1, 0), (1, 2, 1), (2, 3, 2), (3, 4, 90), (4, 4, 40), (5, 5, 3)]), located(spark, SITES))
    rows = {r["seq"]: r for r in found.collect()}
    assert rows[0]["rank"] == 4 and rows[3]["rank"] <= 1 and {s for s, r in rows.items() if r["kept"]} == {1, 2, 3}
    out = sitesearch.outcome(found).first()
    assert (out["read"], out["best"], out["stopped_early"], out["blocked"]) == (3, 4, True, 1)


def test_decisions_by_distinct_thresholds_are_those_in_full(spark, sf):
    from airgate.operators import emissions, pathway
    from airgate.sources import derived

    ozone, soft = (None, "extreme", "severe-15", "serious", "moderate", None), (None, "serious", "moderate")
    rows = [(k, ("GA", "CA", "TX", "NJ")[k % 4], "x", k % 7 == 0, "hostile" if k % 3 else "by-right", float(k * 5 % 40), ozone[k % 6]) for k in range(1, 25)]
    places = located(spark, rows)
    for j, p in enumerate(("pm25", "pm10", "co", "so2")):
        held = F.lit(None).cast("string")
        for k in range(1, 25):
            held = F.when(F.col("site_id") == k, soft[(k + j) // (j + 1) % 3]).otherwise(held)
        places = places.withColumn(f"{p}_class", held)
    around = candidates(spark, [(k - 1, k, k * 7 % 5) for k in range(1, 25)])
    pte = emissions.estimate(derived.plants(spark, sf).where("pmod(xxhash64(plant_id), 10) = 0").withColumn("l_suppkey", F.lit(1).cast("long")))
    # Plants are compared with distinct thresholds, and what is kept of a candidate is a number.
    laid = sitesearch.around(around, places)
    one = laid.select(F.size("limits").alias("limits"), F.size(F.col("kinds")[0]["places"]).alias("places")).first()
    assert 5 < one["limits"] < one["places"] == 24
    held = sitesearch.tried(sitesearch.of_kind(pathway.design_in_brief(pte.join(laid, F.col("l_suppkey") == F.col("origin")))), "plant_id")
    assert held.schema["read"].dataType.simpleString() == "array<int>"
    names = ["plant_id", "parcel", "rank", "months_likely", "n_stops"]
    found = sitesearch.searched(pte, around, places).select(*names)
    full = pathway.decide(pte.crossJoin(places)).select("plant_id", F.col("site_id").alias("parcel"), "rank", "months_likely", F.size("stops").alias("n_stops"))
    want = set(map(tuple, full.collect()))
    got = list(map(tuple, found.collect()))
    assert set(got) <= want and len(set(got)) > 1_000 and {r[2] for r in got} >= {1, 3, 4}
