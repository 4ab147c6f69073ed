"""Registered jobs of the rule engine: emissions, designations, pathways, sweep and search, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airgate.functions.rules import CRITERIA, MONTH_DAYS, PATHWAYS, POLLUTANTS, SEVERITY, SIGNIFICANT
from airgate.operators import emissions, pathway
from airgate.plans.base import ORACLES, QUERIES, registered, shown
from airgate.sources import derived
from airgate.sources.derived import SQL

_PTE = f"WITH {SQL['plants']}, {emissions.sql()}"
_OWN = f"WITH {SQL['plants']}, {SQL['sites']}, {SQL['designations']}, {emissions.sql()}, chosen AS (SELECT * FROM pte), {pathway.sql('chosen.l_suppkey = located.site_id')}"
_DESIGNS = f"""WITH {SQL['plants'].replace('plants AS', 'every_plant AS')}, {SQL['sites']}, {SQL['designations']},
plants AS (SELECT mw, prime_mover, fuel, controls, heat_rate, units, 8760::DOUBLE AS run_hours, false AS enforceable, count(*) AS n_plants
  FROM every_plant GROUP BY ALL), {emissions.sql()}, chosen AS (SELECT * FROM pte), {pathway.sql()}"""


def _pte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emissions.estimate(derived.plants(spark, sf_dir))


def _worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pathway.worst_designations(derived.designations(spark, sf_dir))


def at_own_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plant with the facts of the site that it is planned for, joined while a plant is still a narrow row."""
    located = pathway.with_overlay(derived.sites(spark, sf_dir)).join(_worst(spark, sf_dir), "fips", "left")
    li = derived.read(spark, sf_dir, "lineitem")
    return derived.designed(li.join(located, li.l_suppkey == located.site_id), *located.columns)


def at_own_site_in_brief(spark: SparkSession, sf_dir: str, *facts: Column) -> DataFrame:
    """Each plant with `site`, what `pathway.brief` needs of the site that it is planned for, and other facts of it
    (site_cap, the least threshold of its designations, unless others are asked for)."""
    located = pathway.with_overlay(derived.sites(spark, sf_dir)).join(_worst(spark, sf_dir), "fips", "left")
    held = pathway.in_brief(located, "site_id", *(facts or [F.least(*pathway.class_limits()).alias("site_cap")]))
    li = derived.read(spark, sf_dir, "lineitem")
    return derived.designed(li.join(held, li.l_suppkey == held.site_id), *held.columns)


def fuels_at_own_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fuel, the facts of a site and n, how many plants with that fuel are planned for it; plants are counted before they meet their site."""
    located = pathway.with_overlay(derived.sites(spark, sf_dir)).join(_worst(spark, sf_dir), "fips", "left")
    counts = emissions.coherent(derived.plants(spark, sf_dir)).groupBy("l_suppkey", "fuel").agg(F.count("*").alias("n"))
    return counts.join(located, counts.l_suppkey == located.site_id)


def own_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plant decided at the site that it is planned for."""
    return pathway.decide(emissions.estimate(at_own_site(spark, sf_dir)))


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct design, run without a cap, decided at every site; n_plants says how often it is planned."""
    design = ["mw", "prime_mover", "fuel", "controls", "heat_rate", "units"]
    designs = derived.plants(spark, sf_dir).groupBy(*design).agg(F.count("*").alias("n_plants"))
    designs = designs.withColumns({"run_hours": F.lit(8760.0), "enforceable": F.lit(False)})
    return pathway.decide(pathway.pairs(emissions.estimate(designs), derived.sites(spark, sf_dir), _worst(spark, sf_dir)))


def portfolio_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rank, n_stops, months of the portfolio's decisions, with how many there are (n_pairs) and how often they are planned (n_plants).

    A design's rank at a site hangs on the thresholds of the site's county and state only, of which there are as many as
    there are counties, however many sites. So designs are decided once for each set of thresholds and counted by rank and
    kind; sites with one set of thresholds, months and stops are counted too; and the counts are multiplied.
    """
    design = ["mw", "prime_mover", "fuel", "controls", "heat_rate", "units"]
    designs = derived.plants(spark, sf_dir).groupBy(*design).agg(F.count("*").alias("n_plants"))
    designs = pathway.design_in_brief(emissions.estimate(designs.withColumns({"run_hours": F.lit(8760.0), "enforceable": F.lit(False)})))
    located = pathway.with_overlay(derived.sites(spark, sf_dir)).join(_worst(spark, sf_dir), "fips", "left")
    held = pathway.in_brief(located).groupBy("site").agg(F.count("*").alias("n_sites")).withColumn("at", F.col("site").dropFields("months", "stops"))
    told, places = pathway.brief(), F.broadcast(held.select("at").distinct())
    ruled = designs.crossJoin(places.withColumnRenamed("at", "site"))
    for name in ("best", "tough", "rank"):
        ruled = ruled.withColumn(name, F.expr(told[name]))
    ruled = ruled.groupBy(F.col("site").alias("at"), "rank", "kind", "tough").agg(F.count("*").alias("n"), F.sum("n_plants").alias("n_plants"))
    met = held.join(ruled, "at").withColumns({name: F.expr(told[name]) for name in ("months", "n_stops")})
    return met.select("rank", "n_stops", F.col("months"), (F.col("n") * F.col("n_sites")).alias("n_pairs"), (F.col("n_plants") * F.col("n_sites")).alias("n_plants"))


def reference_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference plant at every site."""
    one = spark.range(1, numPartitions=1).select(
        F.lit(500.0).alias("mw"), F.lit("combined_cycle_turbine").alias("prime_mover"), F.lit("natural_gas").alias("fuel"),
        F.array(F.lit("dry_low_nox"), F.lit("scr"), F.lit("oxidation_catalyst")).alias("controls"), F.lit(8760.0).alias("run_hours"),
        F.lit(False).alias("enforceable"), F.lit(None).cast("double").alias("heat_rate"), F.lit(1).alias("units"),
    )
    return pathway.decide(pathway.pairs(emissions.estimate(one), derived.sites(spark, sf_dir), _worst(spark, sf_dir)))


_SWEEP = f"""WITH {SQL['sites']}, {SQL['designations']}, plants AS (SELECT 500.0::DOUBLE AS mw, 'combined_cycle_turbine' AS prime_mover, 'natural_gas' AS fuel,
  ['dry_low_nox', 'scr', 'oxidation_catalyst'] AS controls, 8760::DOUBLE AS run_hours, false AS enforceable, NULL::DOUBLE AS heat_rate, 1 AS units),
{emissions.sql()}, chosen AS (SELECT * FROM pte), {pathway.sql()}"""
_DAYS = f"round(months_likely * {MONTH_DAYS}::DOUBLE, 0)::BIGINT"


def _days():
    return F.round(F.col("months_likely") * MONTH_DAYS, 0).cast("long")


# ---- emissions


@registered(f"{_PTE} SELECT coalesce(rejected, 'ok') AS reason, count(*)::BIGINT AS n FROM pte_all GROUP BY 1")
def prj1_config_errors(spark, sf_dir):
    held = emissions.estimate(derived.plants(spark, sf_dir), with_rejects=True)
    return held.groupBy(F.coalesce("rejected", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@registered(f"{_PTE} SELECT plant_id, round(heat_input, 6) AS heat_input, effective_hours::DOUBLE AS effective_hours, {', '.join(f'round({p}_tpy + 1e-7::DOUBLE, 4) AS {p}_tpy' for p in POLLUTANTS)} FROM pte")
def prj4_pte(spark, sf_dir):
    return _pte(spark, sf_dir).select("plant_id", F.round("heat_input", 6).alias("heat_input"), "effective_hours", *[shown(f"{p}_tpy").alias(f"{p}_tpy") for p in POLLUTANTS])


@registered(f"""{_PTE} SELECT plant_id, concat_ws(',', {', '.join(f"CASE WHEN {p}_tpy >= {r!r} THEN '{p}' END" for p, r in SIGNIFICANT.items())}) AS significant FROM pte""")
def prj5_significant(spark, sf_dir):
    return _pte(spark, sf_dir).select("plant_id", F.array_join(emissions.significant(), ",").alias("significant"))


@registered(f"""{_PTE} SELECT plant_id, CASE {' '.join(f"WHEN {p}_tpy = most THEN '{p}'" for p in CRITERIA)} END AS largest, round(most + 1e-7::DOUBLE, 4) AS tpy
FROM (SELECT *, greatest({', '.join(f'{p}_tpy' for p in CRITERIA)}) AS most FROM pte)""")
def prj6_largest_criteria(spark, sf_dir):
    held = _pte(spark, sf_dir).withColumn("l", emissions.largest_criteria())
    return held.select("plant_id", F.col("l.name").alias("largest"), shown("l.tpy").alias("tpy"))


@registered(f"""{_PTE} SELECT plant_id, CASE WHEN nox_tpy * 8760 / effective_hours > 250 AND 8760 * 250 / (nox_tpy * 8760 / effective_hours) >= 1
THEN round(8760 * 250 / (nox_tpy * 8760 / effective_hours) + 1e-7::DOUBLE, 4) END AS hours FROM pte""")
def prj7_hours_to_hold(spark, sf_dir):
    return _pte(spark, sf_dir).select("plant_id", shown(emissions.hours_to_hold(F.col("nox_tpy"), 250.0, F.col("effective_hours"))).alias("hours"))


# ---- designations


@registered(f"""WITH {SQL['designations']} SELECT row_id, fips, pollutant, classification FROM designations WHERE nonattain = 'Yes' AND revoked_na = '' AND yr2026 <> ''""")
def flt1_in_force(spark, sf_dir):
    d = derived.designations(spark, sf_dir)
    return d.where("nonattain = 'Yes' and revoked_na = '' and yr2026 <> ''").select("row_id", "fips", "pollutant", "classification")


@registered(f"""WITH {SQL['designations']}, areas AS (
  SELECT 'A' || (s_suppkey % 50)::VARCHAR AS composid, ['ozone', 'pm25', 'pm10', 'co', 'so2', 'no2', 'lead'][(s_suppkey % 7 + 1)::INT] AS pollutant, max(s_suppkey) AS area, max(s_acctbal) AS dv FROM supplier GROUP BY 1, 2)
SELECT d.row_id, a.area, a.dv FROM designations d LEFT JOIN areas a ON d.composid = a.composid AND d.pollutant = a.pollutant""")
def join1_designation_areas(spark, sf_dir):
    s = derived.read(spark, sf_dir, "supplier")
    pollutant = F.element_at(F.array(*[F.lit(p) for p in ("ozone", "pm25", "pm10", "co", "so2", "no2", "lead")]), (F.col("s_suppkey") % 7 + 1).cast("int"))
    areas = s.groupBy(F.concat(F.lit("A"), (F.col("s_suppkey") % 50).cast("string")).alias("composid"), pollutant.alias("pollutant"))
    areas = areas.agg(F.max("s_suppkey").alias("area"), F.max("s_acctbal").alias("dv"))
    return derived.designations(spark, sf_dir).join(areas, ["composid", "pollutant"], "left").select("row_id", "area", "dv")


@registered(f"""WITH {SQL['designations']}, {SQL['sites']} SELECT site_id, count(row_id)::BIGINT AS n, coalesce(bool_or(part = 'P'), false) AS partial
FROM sites LEFT JOIN designations ON sites.fips = designations.fips AND nonattain = 'Yes' GROUP BY 1""")
def join2_county_designations(spark, sf_dir):
    d = derived.designations(spark, sf_dir).where("nonattain = 'Yes'").groupBy("fips").agg(F.count("*").alias("n"), F.bool_or(F.col("part") == "P").alias("partial"))
    return derived.sites(spark, sf_dir).join(d, "fips", "left").select("site_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("partial", F.lit(False)).alias("partial"))


@registered(f"""WITH {SQL['designations']} SELECT fips, pollutant, arg_min(classification, list_position([{', '.join(f"'{s}'" for s in SEVERITY)}], classification)::BIGINT * 1000000000 + row_id) AS worst
FROM designations WHERE nonattain = 'Yes' AND revoked_na = '' AND yr2026 <> '' GROUP BY 1, 2""")
def agg4_worst_designation(spark, sf_dir):
    force = flt1_in_force(spark, sf_dir)
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("classification"))
    return force.groupBy("fips", "pollutant").agg(F.min_by("classification", F.struct(rank, "row_id")).alias("worst"))


@registered(f"""WITH {SQL['designations']} SELECT coalesce(pollutant, 'all') AS pollutant, count(*)::BIGINT AS n, count(DISTINCT fips)::BIGINT AS counties,
count(DISTINCT fips) FILTER (WHERE part = 'P')::BIGINT AS partial FROM designations WHERE nonattain = 'Yes' AND revoked_na = '' AND yr2026 <> '' GROUP BY GROUPING SETS ((pollutant), ())""")
def agg5_designation_counts(spark, sf_dir):
    force = derived.designations(spark, sf_dir).where("nonattain = 'Yes' and revoked_na = '' and yr2026 <> ''")
    got = force.rollup("pollutant").agg(F.count("*").alias("n"), F.countDistinct("fips").alias("counties"), F.countDistinct(F.when(F.col("part") == "P", F.col("fips"))).alias("partial"))
    return got.withColumn("pollutant", F.coalesce("pollutant", F.lit("all")))


@registered(f"WITH {SQL['designations']} SELECT row_id, fips, pollutant, classification, area_name FROM designations ORDER BY fips, pollutant, row_id DESC, area_name")
def top7_designations_ordered(spark, sf_dir):
    return derived.designations(spark, sf_dir).select("row_id", "fips", "pollutant", "classification", "area_name").orderBy("fips", "pollutant", F.desc("row_id"), "area_name")


# ---- pathways


@registered(f"""{_OWN} SELECT plant_id, site_id, pathway, rank, controlling, round(controlling_tpy + 1e-7::DOUBLE, 4) AS controlling_tpy, applicable, round(offsets_tons + 1e-7::DOUBLE, 4) AS offsets_tons,
n_stops, added, round(months_low + 1e-7::DOUBLE, 4) AS months_low, round(months_likely + 1e-7::DOUBLE, 4) AS months_likely, round(months_high + 1e-7::DOUBLE, 4) AS months_high FROM decided""")
def prj12_pathway_at_own_site(spark, sf_dir):
    d = own_site(spark, sf_dir)
    return d.select(
        "plant_id", "site_id", "pathway", "rank", "controlling", shown("controlling_tpy").alias("controlling_tpy"), "applicable", shown("offsets_tons").alias("offsets_tons"),
        F.size("stops").alias("n_stops"), "added", *[shown(f"months_{k}").alias(f"months_{k}") for k in ("low", "likely", "high")],
    )


@registered(f"{_DESIGNS} SELECT pathway, count(*)::BIGINT AS n_decisions, sum(n_plants)::BIGINT AS n_plants, count(*) FILTER (WHERE n_stops > 0)::BIGINT AS n_stopped, round(avg(months_likely) + 1e-7::DOUBLE, 4) AS months FROM decided GROUP BY 1 ORDER BY 2 DESC")
def sweep_pathway_counts(spark, sf_dir):
    n, months = F.sum("n_pairs"), F.sum(F.col("months") * F.col("n_pairs"))
    stopped = F.coalesce(F.sum(F.when(F.col("n_stops") > 0, F.col("n_pairs"))), F.lit(0))
    way = F.element_at(F.array(*[F.lit(p[0]) for p in PATHWAYS]), F.col("rank") + 1)
    got = portfolio_counts(spark, sf_dir).groupBy(way.alias("pathway")).agg(n.alias("n_decisions"), F.sum("n_plants").alias("n_plants"), stopped.alias("n_stopped"), shown(months / n).alias("months"))
    return got.orderBy(F.desc("n_decisions"))


@registered(f"{_SWEEP} SELECT site_id, state, fips, pathway, {_DAYS} AS days, n_stops, round(offsets_tons + 1e-7::DOUBLE, 4) AS offsets_tons, state IN ('VA', 'TX', 'GA', 'OH', 'AZ', 'NJ', 'NM', 'IL') AS modelled FROM decided")
def prj34_score_records(spark, sf_dir):
    d = reference_sweep(spark, sf_dir)
    return d.select("site_id", "state", "fips", "pathway", _days().alias("days"), F.size("stops").alias("n_stops"), shown("offsets_tons").alias("offsets_tons"), F.col("state").isin("VA", "TX", "GA", "OH", "AZ", "NJ", "NM", "IL").alias("modelled"))


@registered(f"{_SWEEP} SELECT CASE WHEN d < 700 THEN 0 WHEN d < 850 THEN 1 WHEN d < 1050 THEN 2 WHEN d < 1350 THEN 3 ELSE 4 END AS bin, count(*)::BIGINT AS n, (max(d) - min(d))::BIGINT AS spread FROM (SELECT {_DAYS} AS d FROM decided) GROUP BY 1")
def prj33_day_bins(spark, sf_dir):
    d = reference_sweep(spark, sf_dir).select(_days().alias("d"))
    cut = F.when(F.col("d") < 700, 0).when(F.col("d") < 850, 1).when(F.col("d") < 1050, 2).when(F.col("d") < 1350, 3).otherwise(4)
    return d.groupBy(cut.alias("bin")).agg(F.count("*").alias("n"), (F.max("d") - F.min("d")).alias("spread"))


@registered(f"{_SWEEP} SELECT pathway, count(*)::BIGINT AS n, count(*) FILTER (WHERE n_stops > 0)::BIGINT AS stopped, count(*) FILTER (WHERE gas_pipeline_km IS NULL)::BIGINT AS unread FROM decided GROUP BY 1")
def agg2_conditional_counts(spark, sf_dir):
    d = reference_sweep(spark, sf_dir)
    return d.groupBy("pathway").agg(F.count("*").alias("n"), F.count_if(F.size("stops") > 0).alias("stopped"), F.count_if(F.col("gas_pipeline_km").isNull()).alias("unread"))


@registered(f"{_SWEEP} SELECT state, {_DAYS} AS days, count(*)::BIGINT AS tied, min(site_id) AS first_site FROM decided GROUP BY 1, 2")
def agg3_tie_tiers(spark, sf_dir):
    d = reference_sweep(spark, sf_dir).withColumn("days", _days())
    return d.groupBy("state", "days").agg(F.count("*").alias("tied"), F.min("site_id").alias("first_site"))


@registered(f"""{_SWEEP}, t AS (SELECT state, site_id, {_DAYS} AS days, n_stops, row_number() OVER (PARTITION BY state, {_DAYS} ORDER BY n_stops DESC, site_id) AS r, count(*) OVER (PARTITION BY state, {_DAYS}) AS tied FROM decided)
SELECT state, site_id, days, (tied - 1)::BIGINT AS tied_with FROM t WHERE r = 1""")
def win10_tier_representatives(spark, sf_dir):
    d = reference_sweep(spark, sf_dir).select("state", "site_id", _days().alias("days"), F.size("stops").alias("n_stops"))
    tier = Window.partitionBy("state", "days")
    d = d.withColumns({"r": F.row_number().over(tier.orderBy(F.desc("n_stops"), "site_id")), "tied": F.count("*").over(tier)})
    return d.where("r = 1").select("state", "site_id", "days", (F.col("tied") - 1).alias("tied_with"))


def _extremes(name: str, slow: bool):
    sign = "-" if slow else ""

    @registered(f"{_SWEEP} SELECT site_id, state, {_DAYS} AS days, n_stops FROM decided ORDER BY {sign}({_DAYS}), -n_stops, -coalesce(offsets_tons, 0), state, site_id LIMIT 15")
    def job(spark, sf_dir):
        d = reference_sweep(spark, sf_dir).select("site_id", "state", _days().alias("days"), F.size("stops").alias("n_stops"), F.coalesce("offsets_tons", F.lit(0.0)).alias("o"))
        return d.orderBy(F.desc("days") if slow else "days", F.desc("n_stops"), F.desc("o"), "state", "site_id").limit(15).drop("o")

    QUERIES[name], ORACLES[name] = QUERIES.pop("job"), ORACLES.pop("job")


_extremes("top1_fastest", False)
_extremes("top1_slowest", True)


@registered(f"""{_OWN}, t AS (SELECT unnest([
  CASE WHEN coalesce(ozone_class, pm25_class, pm10_class, co_class, so2_class, no2_class, lead_class) IS NOT NULL THEN 'nonattainment_designation' END, pathway,
  CASE WHEN class_i_km <= 300 THEN 'class_i_aqrv' END, CASE WHEN increment_no2 >= 0.5 THEN 'psd_increment_consumed' END, CASE WHEN increment_pm25 >= 0.5 THEN 'psd_increment_consumed' END,
  CASE WHEN largest_tpy >= 100 OR hcho_tpy >= 10 THEN 'title_v' END, CASE WHEN contains(prime_mover, 'turbine') THEN 'nsps_turbine' END, CASE WHEN contains(prime_mover, 'recip') THEN 'nsps_rice' END,
  CASE WHEN state_toxics THEN 'state_toxics' END, CASE WHEN otr THEN 'ozone_transport_region' END, CASE WHEN ej THEN 'ej_denial_authority' END, CASE WHEN terrain_relief_m > 150 THEN 'complex_terrain' END,
  CASE WHEN moratorium THEN 'county_moratorium' END, CASE WHEN zoning_posture = 'hostile' THEN 'zoning_posture' END, CASE WHEN cases > 0 THEN 'litigation' END,
  CASE WHEN fuel = 'natural_gas' AND gas_pipeline_km > 8 THEN 'gas_reachability' END, CASE WHEN units > 1 THEN 'source_aggregation_risk' END]) AS name FROM decided)
SELECT name, count(*)::BIGINT AS n FROM t WHERE name IS NOT NULL GROUP BY 1""")
def agg19_trigger_frequency(spark, sf_dir):
    return pathway.trigger_counts(own_site(spark, sf_dir))


@registered(f"""{_OWN} SELECT plant_id, site_id, target AS cap_threshold, CASE WHEN f > target * 0.9::DOUBLE THEN round(8760 * target * 0.9::DOUBLE / f + 1e-7::DOUBLE, 4) END AS cap_hours,
CASE WHEN f > target * 0.9::DOUBLE THEN 8760 * target * 0.9::DOUBLE / f >= 1000 END AS cap_feasible
FROM (SELECT *, largest_tpy * 8760 / effective_hours AS f, least(threshold,
  CASE ozone_class WHEN 'marginal' THEN 100 WHEN 'moderate' THEN 100 WHEN 'serious' THEN 50 WHEN 'severe-15' THEN 25 WHEN 'extreme' THEN 10 END,
  CASE pm25_class WHEN 'serious' THEN 70 WHEN 'moderate' THEN 100 WHEN 'unclassified' THEN 100 END, CASE pm10_class WHEN 'serious' THEN 70 WHEN 'moderate' THEN 100 WHEN 'unclassified' THEN 100 END,
  CASE co_class WHEN 'serious' THEN 50 WHEN 'moderate' THEN 100 WHEN 'unclassified' THEN 100 END,
  CASE WHEN so2_class IS NOT NULL OR no2_class IS NOT NULL OR lead_class IS NOT NULL THEN 100 END)::DOUBLE AS target FROM decided)""")
def prj17_synthetic_minor_cap(spark, sf_dir):
    d = own_site(spark, sf_dir).withColumns(pathway.synthetic_cap())
    return d.select("plant_id", "site_id", "cap_threshold", shown("cap_hours").alias("cap_hours"), "cap_feasible")


# ---- search: the plants of one order are the candidates of one project


_RANKED = f"""{_OWN}, candidates AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (n_stops > 0)::INT, rank, months_likely, site_id, plant_id) AS place,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY site_id, plant_id) AS seq FROM decided)"""


def _candidates(spark, sf_dir):
    project = Window.partitionBy("l_orderkey")
    stopped = (F.size("stops") > 0).cast("int")
    d = own_site(spark, sf_dir).withColumn("n_stops", F.size("stops"))
    return d.withColumns({"place": F.row_number().over(project.orderBy(stopped, "rank", "months_likely", "site_id", "plant_id")), "seq": F.row_number().over(project.orderBy("site_id", "plant_id"))})


@registered(f"{_RANKED} SELECT l_orderkey AS project, plant_id, site_id, place::INT AS place FROM candidates WHERE place <= 8")
def win1_ranked_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).where("place <= 8").select(F.col("l_orderkey").alias("project"), "plant_id", "site_id", "place")


@registered(f"""{_RANKED}, h AS (SELECT *, min(seq) FILTER (WHERE rank <= 1 AND n_stops = 0) OVER (PARTITION BY l_orderkey) AS stop_at FROM candidates)
SELECT l_orderkey AS project, count(*)::BIGINT AS tried, coalesce(bool_or(seq = stop_at), false) AS found FROM h WHERE seq <= coalesce(stop_at, seq) GROUP BY 1""")
def win4_early_stop(spark, sf_dir):
    hit = F.when((F.col("rank") <= 1) & (F.col("n_stops") == 0), F.col("seq"))
    d = _candidates(spark, sf_dir).withColumn("stop_at", F.min(hit).over(Window.partitionBy("l_orderkey")))
    d = d.where("seq <= coalesce(stop_at, seq)")
    return d.groupBy(F.col("l_orderkey").alias("project")).agg(F.count("*").alias("tried"), F.coalesce(F.bool_or(F.col("seq") == F.col("stop_at")), F.lit(False)).alias("found"))


@registered(f"""{_RANKED}, c AS (SELECT l_orderkey, seq, 36 + (rank >= 3)::INT * 12 AS cost, sum(36 + (rank >= 3)::INT * 12) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS UNBOUNDED PRECEDING) AS spent FROM candidates)
SELECT l_orderkey AS project, count(*)::BIGINT AS read, sum(cost)::BIGINT AS spent FROM c WHERE spent <= 120 GROUP BY 1""")
def win5_budget_cut(spark, sf_dir):
    cost = F.lit(36) + F.when(F.col("rank") >= 3, 12).otherwise(0)
    d = _candidates(spark, sf_dir).withColumn("cost", cost).withColumn("spent", F.sum("cost").over(Window.partitionBy("l_orderkey").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    return d.where("spent <= 120").groupBy(F.col("l_orderkey").alias("project")).agg(F.count("*").alias("read"), F.sum("cost").alias("spent"))


@registered(f"""{_RANKED}, o AS (SELECT l_orderkey, rank AS base_rank, months_likely AS base_months FROM candidates WHERE seq = 1)
SELECT c.l_orderkey AS project, c.plant_id, base_rank - rank AS rank_delta, round(base_months - months_likely + 1e-7::DOUBLE, 4) AS months_saved,
  n_stops = 0 AND (base_rank - rank > 0 OR base_months - months_likely > 1) AS improves FROM candidates c JOIN o ON c.l_orderkey = o.l_orderkey WHERE seq > 1""")
def flt6_improvements(spark, sf_dir):
    d = _candidates(spark, sf_dir).select("l_orderkey", "plant_id", "seq", "rank", "months_likely", "n_stops")
    first = Window.partitionBy("l_orderkey").orderBy("seq")
    d = d.withColumns({"base_rank": F.first("rank").over(first), "base_months": F.first("months_likely").over(first)}).where("seq > 1")
    delta, saved = F.col("base_rank") - F.col("rank"), F.col("base_months") - F.col("months_likely")
    return d.select(F.col("l_orderkey").alias("project"), "plant_id", delta.alias("rank_delta"), shown(saved).alias("months_saved"), ((F.col("n_stops") == 0) & ((delta > 0) | (saved > 1))).alias("improves"))
