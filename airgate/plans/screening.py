"""Registered jobs on what to read for a plant, the bridge to a delay's price, and joins with a fallback key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgate.functions import forms
from airgate.operators import emissions, pathway, pricing, variants
from airgate.plans import permit
from airgate.plans.base import registered
from airgate.plans.permit import _PTE
from airgate.sources import derived
from airgate.sources.derived import SQL, read

# ---- proximity targets of each plant


@registered(f"""{_PTE}, p AS (SELECT plant_id, l_suppkey, controls, mw, fuel, prime_mover, l_suppkey % 4 > 0 AS grid_tied,
  greatest(nox_tpy, co_tpy, pm10_tpy, pm25_tpy, so2_tpy, voc_tpy) >= 0.6::DOUBLE * CASE WHEN prime_mover = 'combined_cycle_turbine' AND heat_input > 250 THEN 100 ELSE 250 END AS shaped FROM pte),
t AS (SELECT plant_id, unnest([
  {{'target': 'gas_pipeline', 'chosen': fuel = 'natural_gas', 'asked': fuel = 'natural_gas'}}, {{'target': 'transmission', 'chosen': grid_tied OR mw > 100, 'asked': grid_tied OR mw > 100}}, {{'target': 'substation', 'chosen': grid_tied OR mw > 100, 'asked': grid_tied OR mw > 100}},
  {{'target': 'airport', 'chosen': contains(prime_mover, 'turbine'), 'asked': true}}, {{'target': 'urban_area', 'chosen': shaped OR prime_mover = 'diesel_recip', 'asked': true}}, {{'target': 'school', 'chosen': shaped OR prime_mover = 'diesel_recip', 'asked': true}}]) AS x FROM p)
SELECT plant_id, x.target AS target, x.chosen AS chosen, CASE WHEN NOT x.chosen AND x.target = 'airport' THEN 'short_stack' WHEN NOT x.chosen THEN 'no_modelling' END AS reason FROM t WHERE x.asked""")
def prj22_proximity_targets(spark, sf_dir):
    """Which nearest features are worth reading for a plant; those that are not are named with their reason."""
    pte = emissions.estimate(derived.plants(spark, sf_dir)).withColumn("grid_tied", F.col("l_suppkey") % 4 > 0)
    return pte.select("plant_id", F.inline(variants.proximity_targets())).where("asked").drop("asked")


# ---- from an assessment to the price of its delay: orders are assessed projects


@registered("""WITH p AS (SELECT o_orderkey AS project_id, (50 + o_orderkey % 400)::DOUBLE AS mw, (o_orderkey % 90 - 45)::DOUBLE AS slack, CASE WHEN o_custkey % 3 = 0 THEN (30 + o_custkey % 200)::DOUBLE END AS stated, o_custkey % 4 > 0 AS grid_tied FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT project_id, greatest(0, -slack) AS months_delayed, coalesce(stated, mw / 1.3::DOUBLE) AS it_load, stated IS NULL AS load_derived, NOT grid_tied AS sole_source FROM p)
SELECT *, floor(it_load * 1000000 / 1275 / 1.0::DOUBLE)::BIGINT AS accelerators, floor(it_load * 1000000 / 1275)::BIGINT * 730::DOUBLE * months_delayed * 0.80::DOUBLE * 2.395::DOUBLE AS usd FROM b""")
def prj32_assessment_bridge(spark, sf_dir):
    """Projects without a slack (no date announced) have no price; the others are late by what their slack lacks."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    slack = F.when(k % 11 != 0, (k % 90 - 45).cast("double"))
    p = read(spark, sf_dir, "orders").select(
        k.alias("project_id"), (50 + k % 400).cast("double").alias("mw"), slack.alias("slack"), F.when(c % 3 == 0, (30 + c % 200).cast("double")).alias("it_load_mw"), (c % 4 > 0).alias("grid_tied")
    )
    return pricing.assessed_delay(p)


# ---- counties joined by FIPS, and by state and name where no FIPS row exists


_NAMED = f"""{SQL['designations']}, {SQL['sites']}, texts AS (SELECT row_id, CASE WHEN row_id % 3 > 0 THEN fips END AS fips, substr(fips, 1, 2)::INT AS state_no, 'County ' || (substr(fips, 3)::INT)::VARCHAR || ' County' AS said, part FROM designations WHERE nonattain = 'Yes')"""


def _bare(name: Column) -> Column:
    return forms.folded(pathway.bare_county(name))


@registered(rf"""WITH {_NAMED}, t AS (SELECT *, trim(regexp_replace(lower(regexp_replace(trim(said), ' county$', '', 'i')), '[^a-z0-9]+', ' ', 'g')) AS name FROM texts),
f AS (SELECT fips, count(*) AS n, bool_or(part = 'P') AS partial FROM t WHERE fips IS NOT NULL GROUP BY 1), m AS (SELECT state_no, name, count(*) AS n, bool_or(part = 'P') AS partial FROM t WHERE fips IS NULL GROUP BY 1, 2)
SELECT site_id, coalesce(f.n, m.n, 0)::BIGINT AS n, CASE WHEN f.n IS NOT NULL THEN f.partial ELSE coalesce(m.partial, false) END AS partial, CASE WHEN f.n IS NOT NULL THEN 'fips' WHEN m.n IS NOT NULL THEN 'name' ELSE 'none' END AS found_by
FROM sites s LEFT JOIN f ON s.fips = f.fips LEFT JOIN m ON m.state_no = substr(s.fips, 1, 2)::INT AND m.name = trim(regexp_replace(lower(s.county), '[^a-z0-9]+', ' ', 'g'))""")
def join2_designations_by_fips_or_name(spark, sf_dir):
    """A county takes its FIPS rows if there are any, else those that name it and its state, and else has none."""
    d = derived.designations(spark, sf_dir).where("nonattain = 'Yes'")
    number = F.substring("fips", 3, 3).cast("int").cast("string")
    d = d.select(F.when(F.col("row_id") % 3 > 0, F.col("fips")).alias("fips"), F.substring("fips", 1, 2).cast("int").alias("state_no"), F.concat(F.lit("County "), number, F.lit(" County")).alias("said"), "part")
    sites = derived.sites(spark, sf_dir).select("site_id", "fips", F.substring("fips", 1, 2).cast("int").alias("state_no"), "county")
    return by_fips_or_name(sites, d)


def by_fips_or_name(sites: DataFrame, texts: DataFrame) -> DataFrame:
    n, partial = F.count("*"), F.bool_or(F.col("part") == "P")
    coded = texts.where("fips is not null").groupBy("fips").agg(n.alias("n1"), partial.alias("p1"))
    named = texts.where("fips is null").groupBy("state_no", _bare(F.col("said")).alias("name")).agg(n.alias("n2"), partial.alias("p2"))
    held = sites.withColumn("name", _bare(F.col("county"))).join(coded, "fips", "left").join(named, ["state_no", "name"], "left")
    first = F.col("n1").isNotNull()
    how = F.when(first, "fips").when(F.col("n2").isNotNull(), "name").otherwise("none")
    return held.select("site_id", F.coalesce("n1", "n2", F.lit(0).cast("long")).alias("n"), F.when(first, F.col("p1")).otherwise(F.coalesce("p2", F.lit(False))).alias("partial"), how.alias("found_by"))


@registered(f"""WITH {SQL['sites']}, posture AS (SELECT CASE WHEN c_custkey % 5 > 0 THEN lpad((c_nationkey + 1)::VARCHAR, 2, '0') || lpad((c_custkey % 60)::VARCHAR, 3, '0') END AS fips, c_nationkey + 1 AS state_no, 'County ' || (c_custkey % 60)::VARCHAR AS county, c_custkey AS record FROM customer WHERE c_custkey % 3 > 0),
f AS (SELECT fips, max(record) AS record FROM posture WHERE fips IS NOT NULL GROUP BY 1), m AS (SELECT state_no, county, max(record) AS record FROM posture WHERE fips IS NULL GROUP BY 1, 2)
SELECT s.site_id, coalesce(f.record, m.record) AS record FROM sites s LEFT JOIN f ON s.fips = f.fips LEFT JOIN m ON m.state_no = substr(s.fips, 1, 2)::INT AND m.county = s.county""")
def join3_posture_by_state_and_name(spark, sf_dir):
    """The record of the county's FIPS, else of its name in its own state."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").where("c_custkey % 3 > 0")
    fips = F.when(k % 5 > 0, F.concat(F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 3, "0")))
    posture = c.select(fips.alias("fips"), (F.col("c_nationkey") + 1).alias("state_no"), F.concat(F.lit("County "), (k % 60).cast("string")).alias("county"), k.alias("record"))
    coded = posture.where("fips is not null").groupBy("fips").agg(F.max("record").alias("by_fips"))
    named = posture.where("fips is null").groupBy("state_no", "county").agg(F.max("record").alias("by_name"))
    sites = derived.sites(spark, sf_dir).select("site_id", "fips", F.substring("fips", 1, 2).cast("int").alias("state_no"), "county")
    held = sites.join(coded, "fips", "left").join(named, ["state_no", "county"], "left")
    return held.select("site_id", F.coalesce("by_fips", "by_name").alias("record"))


# ---- all month adders of each site, largest first


_ADDERS = """[{'m': CASE WHEN rank = 4 THEN 6 ELSE 0 END, 'n': 'major_nonattainment_nsr'}, {'m': CASE WHEN major AND class_i_km <= 100 THEN 6 WHEN major AND class_i_km <= 300 THEN 2 ELSE 0 END, 'n': 'class_i_aqrv'},
  {'m': CASE WHEN major AND increment_no2 >= 0.8 THEN 6 WHEN major AND increment_no2 >= 0.5 THEN 2 ELSE 0 END, 'n': 'psd_increment_consumed'}, {'m': CASE WHEN major AND increment_pm25 >= 0.8 THEN 6 WHEN major AND increment_pm25 >= 0.5 THEN 2 ELSE 0 END, 'n': 'psd_increment_consumed'},
  {'m': CASE WHEN state_toxics THEN 2 ELSE 0 END, 'n': 'state_toxics'}, {'m': CASE WHEN otr THEN 3 ELSE 0 END, 'n': 'ozone_transport_region'}, {'m': CASE WHEN ej THEN 4 ELSE 0 END, 'n': 'ej_denial_authority'}, {'m': CASE WHEN terrain_relief_m > 150 THEN 2 ELSE 0 END, 'n': 'complex_terrain'},
  {'m': CASE WHEN zoning_posture = 'hostile' THEN 6 ELSE 0 END, 'n': 'zoning_posture'}, {'m': CASE WHEN cases > 0 THEN 3 ELSE 0 END, 'n': 'litigation'}, {'m': CASE WHEN fuel = 'natural_gas' AND gas_pipeline_km > 25 THEN 12 WHEN fuel = 'natural_gas' AND gas_pipeline_km > 8 THEN 4 ELSE 0 END, 'n': 'gas_reachability'},
  {'m': CASE WHEN units > 1 THEN 3 ELSE 0 END, 'n': 'source_aggregation_risk'}]"""


@registered(f"""{permit._OWN} SELECT plant_id, site_id, array_to_string(list_transform(list_sort(list_transform(list_filter({_ADDERS}, lambda x: x.m > 0), lambda x: {{'m': -x.m, 'n': x.n}}))[1:3], lambda x: x.n), ',') AS top FROM decided""")
def top3_month_adders(spark, sf_dir):
    """The three triggers of any kind that add most months; of equal ones the first by name."""
    held = F.filter("triggers", lambda t: t["months"] > 0)
    ranked = F.slice(F.array_sort(F.transform(held, lambda t: F.struct((-t["months"]).alias("m"), t["name"].alias("n")))), 1, 3)
    return permit.own_site(spark, sf_dir).select("plant_id", "site_id", F.array_join(F.transform(ranked, lambda x: x["n"]), ",").alias("top"))
