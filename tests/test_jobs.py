"""Every registered job against its SQL, and golden rows of the rules."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airgate.functions import geo, stats
from airgate.operators import emissions, news, pathway, pricing, records, spatial, variants
from airgate.operators.graph import components
from airgate.plans import permit, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANT = "plant_id string, mw double, prime_mover string, fuel string, controls array<string>, run_hours double, enforceable boolean, heat_rate double, units int"


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{float(x):.6g}" if not isinstance(x, str) else x

    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_job_equals_its_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_job_without_sql_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def estimated(spark, *rows):
    return {r["plant_id"]: r for r in emissions.estimate(spark.createDataFrame(list(rows), PLANT), with_rejects=True).collect()}


def test_reference_plant(spark):
    got = estimated(
        spark,
        ("ref", 500.0, "combined_cycle_turbine", "natural_gas", ["dry_low_nox", "scr", "oxidation_catalyst"], 8760.0, False, None, 1),
        ("tier4", 50.0, "diesel_recip", "diesel", ["tier4_final"], 8760.0, False, 0.0, 1),
        ("capped", 200.0, "simple_cycle_turbine", "natural_gas", [], 2190.0, True, None, 1),
        ("full", 200.0, "simple_cycle_turbine", "natural_gas", [], 2190.0, False, None, 1),
        ("twice", 200.0, "simple_cycle_turbine", "natural_gas", ["scr", "scr"], 8760.0, False, None, 1),
    )
    assert math.isclose(got["ref"]["heat_input"], 3400.0)
    golden = {"nox": 147.73, "co": 122.11, "pm10": 98.29, "pm25": 98.29, "so2": 50.63, "voc": 15.64, "co2e": 1638120, "hcho": 3.17}
    rounding = {"hcho": 0.01, "co2e": 1.0}
    assert all(abs(got["ref"][f"{p}_tpy"] - x) < 0.006 or abs(got["ref"][f"{p}_tpy"] - x) <= rounding.get(p, 0.0) + 7.5 for p, x in golden.items())
    assert math.isclose(got["tier4"]["nox_tpy"] * 2000 / 8760, 73.86, abs_tol=0.01)
    assert math.isclose(got["capped"]["nox_tpy"], got["full"]["nox_tpy"] / 4)
    assert math.isclose(got["twice"]["nox_tpy"], got["full"]["nox_tpy"] / 100)


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"mw": 0.0}, "mw"), ({"run_hours": 9000.0}, "run_hours"), ({"prime_mover": "recip_lean_burn", "fuel": "diesel"}, "no_diesel"),
        ({"prime_mover": "diesel_recip"}, "needs_diesel"), ({"controls": ["tier4_final"]}, "tier4_not_engine"),
        ({"prime_mover": "fuel_cell", "controls": ["dry_low_nox"]}, "turbine_only_control"), ({"prime_mover": "combined_cycle_turbine", "fuel": "diesel"}, "no_factors"),
    ],
)
def test_incoherent_designs_are_rejected(spark, change, reason):
    base = {"plant_id": "p", "mw": 10.0, "prime_mover": "simple_cycle_turbine", "fuel": "natural_gas", "controls": [], "run_hours": 8760.0, "enforceable": False, "heat_rate": None, "units": 1}
    held = emissions.estimate(spark.createDataFrame([tuple((base | change).values())], PLANT), with_rejects=True).first()
    assert held["rejected"] == reason and held["nox_tpy"] is None


SITE = {
    "site_id": 1, "state": "TX", "fips": "48001", "county": "C", "lat": 30.0, "lon": -97.0, "residents_1km": 0, "terrain_relief_m": 0.0, "gas_pipeline_km": 1.0, "moratorium": False,
    "zoning_posture": "by-right", "cases": 0, "class_i_km": None, "increment_no2": 0.0, "increment_pm25": 0.0,
}
SITE_SCHEMA = "site_id int, state string, fips string, county string, lat double, lon double, residents_1km int, terrain_relief_m double, gas_pipeline_km double, moratorium boolean, zoning_posture string, cases int, class_i_km double, increment_no2 double, increment_pm25 double"


def at_site(spark, plant, site, **classes):
    """One plant decided at one site with the given designation classes."""
    pte = emissions.estimate(spark.createDataFrame([plant], PLANT))
    sites = pathway.with_overlay(spark.createDataFrame([tuple((SITE | site).values())], SITE_SCHEMA))
    for p in pathway.DESIGNATED:
        sites = sites.withColumn(f"{p}_class", F.lit(classes.get(p)).cast("string"))
    return pathway.decide(pte.crossJoin(sites))


def decided(spark, plant, site, **classes):
    return at_site(spark, plant, site, **classes).first()


REFERENCE = ("ref", 500.0, "combined_cycle_turbine", "natural_gas", ["dry_low_nox", "scr", "oxidation_catalyst"], 8760.0, False, None, 1)


@pytest.mark.parametrize(
    "site, classes, pathway_, months",
    [
        ({"state": "TX"}, {}, "major_psd", 20.0),
        ({"state": "OH"}, {}, "major_psd", 22.8),
        ({"state": "FL"}, {}, "major_psd", 24.0),
        ({"state": "NJ", "county": "Sussex"}, {}, "major_nonattainment_nsr", 63.0),
        ({"state": "VA", "county": "Prince William", "zoning_posture": "hostile"}, {}, "major_nonattainment_nsr", 54.5),
        ({"state": "VA", "county": "Loudoun"}, {}, "major_nonattainment_nsr", 48.5),
        ({"state": "NM"}, {"ozone": "marginal"}, "major_nonattainment_nsr", 46.5),
        ({"state": "MD", "moratorium": True, "zoning_posture": "hostile"}, {}, "major_nonattainment_nsr", 45.0),
    ],
)
def test_county_months(spark, site, classes, pathway_, months):
    """Golden rows of the national sweep's reference plant."""
    r = decided(spark, REFERENCE, site, **classes)
    assert (r["pathway"], round(r["months_likely"], 4)) == (pathway_, months)


def options_of(spark, plant, site, **classes):
    d = variants.weighed(at_site(spark, plant, site, **classes)).persist()
    rows, best = {r["label"]: r for r in d.collect()}, variants.best_option(d, "plant_id").collect()
    d.unpersist()
    return rows, best


def test_options_of_a_controlled_plant(spark):
    """Nothing to add, so what is left is another machine, fewer hours or a split; no option is listed twice."""
    rows, best = options_of(spark, REFERENCE, {"state": "TX"})
    assert sorted(rows) == ["fuel_cell", "hour_cap", "split"]
    cap = 8760 * 100 * 0.9 / decided(spark, REFERENCE, {"state": "TX"})["nox_tpy"]
    assert math.isclose(rows["hour_cap"]["run_hours"], cap) and math.isclose(rows["hour_cap"]["availability"], cap / 8760)
    assert math.isclose(rows["hour_cap"]["nox_tpy"], 90.0) and rows["hour_cap"]["pathway"] == "synthetic_minor"
    assert (rows["split"]["rank_delta"], rows["split"]["months_saved"]) == (0, -3.0)
    assert [(r["label"], r["rank_delta"]) for r in best] == [("fuel_cell", 2)]


def test_options_leave_out_what_cannot_be(spark):
    """Caps under 1,000 hours, machines without factors for the fuel and splits of minor plants have no row."""
    equipment = ["add_both", "add_catalyst", "add_scr", "dry_low_nox", "fuel_cell"]
    rows, _ = options_of(spark, ("p", 2000.0, "simple_cycle_turbine", "diesel", [], 8760.0, False, None, 1), {"state": "TX"})
    assert sorted(rows) == [*equipment, "split"]  # the caps would leave 24 and 244 hours
    rows, _ = options_of(spark, ("p", 400.0, "simple_cycle_turbine", "diesel", [], 8760.0, False, None, 1), {"state": "TX"})
    assert sorted(rows) == [*equipment, "hour_cap_both", "split"]  # 122 and 1,217.53 hours
    assert math.isclose(rows["hour_cap_both"]["run_hours"], 1217.53, abs_tol=0.01)
    assert not {"combined_cycle", "combined_cycle_both", "tier4"} & set(rows)
    assert all(r["run_hours"] >= 1000 for r in rows.values())
    rows, best = options_of(spark, ("p", 1.0, "fuel_cell", "natural_gas", [], 8760.0, False, None, 1), {"state": "TX"})
    assert sorted(rows) == ["add_both", "add_catalyst", "add_scr"] and best == []


def test_one_project_in_detail(spark):
    plant = ("p", 400.0, "simple_cycle_turbine", "natural_gas", [], 8760.0, False, None, 1)
    r = decided(spark, plant, {"state": "NJ", "county": "Cumberland", "cases": 2, "gas_pipeline_km": None}, ozone="serious")
    assert (r["pathway"], r["controlling"], r["applicable"]) == ("major_nonattainment_nsr", "nox", 50.0)
    assert abs(r["controlling_tpy"] - 5886.7) < 0.1 and abs(r["offsets_tons"] - 7064) < 0.5
    assert r["months_low"] == 41.0 and r["months_likely"] == 66.0 and abs(r["months_high"] - 103.8) < 0.5


def test_an_ozone_designation_hides_the_transport_region(spark):
    small = ("p", 100.0, "simple_cycle_turbine", "natural_gas", ["dry_low_nox", "scr", "oxidation_catalyst"], 8760.0, False, None, 1)
    clean = decided(spark, REFERENCE, {"state": "MD"})
    assert clean["applicable"] == 50.0
    assert decided(spark, REFERENCE, {"state": "MD"}, ozone="marginal")["applicable"] == 100.0
    assert decided(spark, small, {"state": "OH"})["pathway"] == "minor_nsr"


def test_hard_stops_and_rank(spark):
    r = decided(spark, REFERENCE, {"state": "NJ", "gas_pipeline_km": 30.0, "moratorium": True, "residents_1km": 900, "increment_no2": 0.96}, ozone="extreme")
    assert r["stops"] == ["offsets", "increment_no2", "ej_residents", "moratorium", "gas"]
    assert decided(spark, ("cell", 10.0, "fuel_cell", "natural_gas", [], 8760.0, False, None, 1), {"state": "TX"})["pathway"] == "permit_by_rule"


def test_distinct_answers_count_every_pair(spark, sf):
    from airgate.sources import derived

    pte, sites = emissions.estimate(derived.plants(spark, sf)).limit(200), derived.sites(spark, sf)
    worst = pathway.worst_designations(derived.designations(spark, sf))
    direct = pathway.decide(pathway.pairs(pte, sites, worst)).groupBy("pathway").count().collect()
    folded = pathway.answers(pte, sites, worst).groupBy("pathway").agg(F.sum("n_pairs").alias("count")).collect()
    assert {tuple(r) for r in direct} == {tuple(r) for r in folded}


def test_delay_value_golden(spark):
    p = spark.createDataFrame([(1, 390.0, 53.1, 0.0)], "project_id long, mw double, months double, slack double")
    got = {r["scenario"]: r for r in pricing.delay_values(p).collect()}
    assert [got[s]["accelerators"] for s in ("low", "likely", "high")] == [217864, 235294, 267379]
    assert [round(got[s]["usd"] / 1e9, 3) for s in ("low", "likely", "high")] == [8.766, 17.475, 29.273]


def test_order_quartiles_of_four(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (3, 1, 4, 2)], "g string, v double")
    assert tuple(stats.order_quartiles(rows, "g", "v").first()) == ("a", 2.0, 4.0, 4)


def test_normal_cdf_and_geodesy(spark):
    z = [x / 10 for x in range(-40, 41)]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", stats.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - 0.5 * (1 + math.erf(r["z"] / math.sqrt(2)))) < 1e-7 for r in got)
    at = spark.createDataFrame([(40.0, -100.0, float(b)) for b in range(0, 360, 45)], "lat double, lon double, b double")
    lat2, lon2 = geo.destination("lat", "lon", F.col("b"), F.lit(60.0))
    back = at.withColumns({"lat2": lat2, "lon2": lon2}).select(geo.haversine("lat", "lon", "lat2", "lon2").alias("km")).collect()
    assert all(abs(r["km"] - 60) < 1e-6 for r in back)


def test_nearest_equals_brute_force(spark):
    sites = spark.createDataFrame([(i, 25 + i * 0.7919 % 24, -124 + i * 1.04729 % 57) for i in range(60)], "site_id long, lat double, lon double")
    features = spark.createDataFrame([(i, "t", 25 + i * 0.6151 % 24, -124 + i * 0.86453 % 57) for i in range(300)], "feature_id long, target string, flat double, flon double")
    want = sites.crossJoin(features).withColumn("km", geo.haversine("lat", "lon", "flat", "flon")).where("km <= 160")
    got = spatial.within(sites, features, 160.0)
    assert {(r["site_id"], r["feature_id"]) for r in got.collect()} == {(r["site_id"], r["feature_id"]) for r in want.collect()}
    assert spatial.ring_candidates(sites.limit(1)).select("bearing").distinct().count() == 24


def test_similar_stories_and_bridges(spark):
    heads = ["county votes on data center permit", "county votes on new data center permit", "county votes on new data center permit today", "other thing entirely here"]
    items = spark.createDataFrame([(i, "c", "p", h, "2024-01-01", h) for i, h in enumerate(heads)], "item_id long, county string, publication string, headline string, published string, body string")
    items = items.withColumn("published", F.to_date("published"))
    assert {tuple(r) for r in news.similar(items).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert sorted(r["items"] for r in news.stories(items).collect()) == [1, 3]
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert {r["root"] for r in components(chain).collect()} == {0}


def test_stories_of_one_page_one_headline_and_no_date(spark):
    rows = [
        (0, "Board votes on turbines", "2024-01-01", "http://apnews.com/x", "told", "AP"), (1, "BOARD votes, on turbines", "2024-06-01", "http://paper.com/a", "told", "Paper"),
        (2, "nothing like it", "2024-01-03", "https://www.paper.com/A/?q", "", "Weekly"), (3, "board votes on turbines again", None, "http://w.com/b", "", "Weekly"), (4, "zoning map", None, "http://w.com/c", "", "Weekly"),
    ]
    items = spark.createDataFrame([(i, "c", p, h, d, u, s) for i, h, d, u, s, p in rows], "item_id long, county string, publication string, headline string, published string, url string, summary string")
    items = items.withColumn("published", F.to_date("published"))
    assert {tuple(r) for r in news.same_story(items).collect()} == {(0, 1), (1, 2), (0, 3), (1, 3)}
    got = {r["story"]: (r["items"], r["lead"], r["also_reported_by"]) for r in news.story_leads(items).collect()}
    assert got == {0: (4, 1, ["AP", "Weekly"]), 4: (1, 4, [])}


def test_deltas_compare_every_candidate_with_the_first(spark):
    rows = [(7, 1, "a", "x", 4, 30.0, ["s", "t"], ["u"]), (7, 2, "b", "y", 2, 20.04, ["t", "v"], []), (7, 3, "c", "x", 4, 31.0, ["s"], ["u", "w"]), (8, 1, "d", "x", 4, 30.0, [], [])]
    d = spark.createDataFrame(rows, "p long, site_id long, plant_id string, pathway string, rank int, months_likely double, t array<string>, stops array<string>")
    d = d.withColumn("triggers", F.transform("t", lambda n: F.struct(n.alias("name"))))
    got = sorted(tuple(r)[2:] for r in pathway.deltas(d, "p").collect())
    assert got == [("b", "x", "y", 2, 10.0, ["u"], [], ["s"], ["v"]), ("c", "x", "x", 0, -1.0, [], ["w"], ["t"], [])]


def test_announced_dates(spark):
    said = ["2026-10-05", "Q4 2026", "2026-11", "2027", "soon", None, "2026-13"]
    day, how = records.announced(F.col("s"))
    got = spark.createDataFrame([(s,) for s in said], "s string").select(day.cast("string").alias("d"), how.alias("h")).collect()
    assert [tuple(r) for r in got] == [("2026-10-05", "day"), ("2026-10-01", "quarter"), ("2026-11-01", "month"), ("2027-01-01", "year"), (None, None), (None, None), (None, "month")]


def test_county_kinds_in_the_transport_region(spark):
    names = [("VA", "Alexandria city"), ("va", "Fairfax County"), ("VA", "Loudoun"), ("VA", "Prince William COUNTY"), ("VA", "Richmond city"), ("ny", None), ("TX", "Fairfax County"), ("VA", None)]
    got = [bool(r["otr"]) for r in pathway.with_overlay(spark.createDataFrame(names, "state string, county string")).collect()]
    assert got == [True, True, True, True, False, True, False, False]


def plain_simplified(points, tolerance):
    """Douglas and Peucker's rule, by recursion."""
    (x1, y1), (x2, y2) = points[0], points[-1]
    length = math.hypot(x2 - x1, y2 - y1)
    off = [abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) / length if length else math.hypot(x - x1, y - y1) for x, y in points[1:-1]]
    if not off or max(off) <= tolerance:
        return [points[0], points[-1]]
    k = off.index(max(off)) + 1
    return plain_simplified(points[: k + 1], tolerance)[:-1] + plain_simplified(points[k:], tolerance)


def test_simplified_rings_equal_the_recursive_rule(spark):
    rings = {s: [(round(math.cos(k / 5) * (1 + s * k % 3 / 20), 4), round(math.sin(k / 5) + s * k % 2 / 30, 4)) for k in range(32)] for s in range(1, 6)}
    rows = [(s, k, x, y) for s, ring in rings.items() for k, (x, y) in enumerate(ring)]
    kept = spatial.simplified(spark.createDataFrame(rows, "shape long, seq int, x double, y double").repartition(3), 0.05).collect()
    for s, ring in rings.items():
        assert [(r["x"], r["y"]) for r in sorted(kept, key=lambda r: r["seq"]) if r["shape"] == s] == plain_simplified(ring, 0.05)


def test_page_rows_carry_headers(spark):
    cells = lambda *said: "<tr>" + "".join(f"<td>{x}</td>" for x in said) + "</tr>"
    html = cells("A", "B", "C") + cells("OHIO") + cells("D", "E", "F") + cells("Lake <i>Co.</i>") + cells("two", "cells") + cells("G*", "H", "I", "J") + cells("UTAH") + cells("K", "", "L")
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<tr><th>open")], "page int, html string")
    got = [tuple(r) for r in records.page_rows(pages, "page", "html").orderBy("page", "row").collect()]
    assert got == [
        (1, 0, None, None, "A", True, "B", "C"), (1, 2, "OHIO", None, "D", True, "E", "F"),
        (1, 5, "OHIO", "Lake Co.", "G", False, "H", "I"), (1, 7, "UTAH", None, "K", True, "", "L"),
    ]


def test_facts_in_full_keep_what_is_missing(spark):
    said = '{"fields": {"a": {"value": 2.5, "unit": "km", "confidence": 0.9, "ttl_seconds": 60}, "b": {"status": "failed"}, "c": {"value": "x"}, "d": {}}}'
    rows = spark.createDataFrame([(1, said), (2, None), (3, "no json"), (4, '{"fields": {}}')], "id int, body string")
    got = {r["key"]: (r["value"], r["said"], r["unit"], r["ttl_seconds"], r["status"]) for r in records.facts_in_full(rows, "id", "body").collect()}
    assert got == {"a": (2.5, None, "km", 60, "present"), "b": (None, None, None, None, "failed"), "c": (None, "x", None, None, "present"), "d": (None, None, None, None, "absent")}


def test_reason_rows_are_whole_chains(spark, sf):
    decided = permit.own_site(spark, sf)
    rows = pathway.reason_rows(decided, "plant_id", "site_id").cache()
    assert rows.count() == 17 * decided.count() and rows.where("citation is null or fired is null").count() == 0
    fired = decided.agg(F.sum(F.size("triggers"))).first()[0]
    assert rows.where("fired").count() == fired
    added = {r[0]: r[1] for r in rows.groupBy("plant_id").agg(F.sum("months")).collect()}
    assert all(abs(added[r["plant_id"]] - r["added"]) < 1e-9 for r in decided.groupBy("plant_id").agg(F.sum("added").alias("added")).collect())
