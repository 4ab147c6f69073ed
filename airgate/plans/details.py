"""Registered jobs on equipment variants, reasons, text forms, parsed feeds and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgate.functions import forms
from airgate.functions.rules import CRITERIA, POLLUTANTS
from airgate.operators import emissions, news, pathway, variants
from airgate.plans import permit
from airgate.plans.base import registered, shown
from airgate.plans.permit import _OWN, _PTE, _SWEEP
from airgate.sources import derived, feeds
from airgate.sources.derived import SQL, read

# ---- equipment variants of each plant, decided at its own site


_VARIANTS = f"""WITH {SQL['plants'].replace('plants AS', 'base AS')}, {SQL['sites']}, {SQL['designations']},
plants AS (SELECT plant_id, l_suppkey, mw, v.prime_mover, v.fuel, v.controls, run_hours, enforceable, CASE WHEN v.ord IN (4, 5) THEN NULL ELSE heat_rate END AS heat_rate, v.units, v.label, v.ord FROM (
  SELECT *, unnest(list_filter([
    CASE WHEN contains(prime_mover, 'turbine') AND NOT list_contains(controls, 'scr') THEN {{'label': 'add_scr', 'ord': 1, 'prime_mover': prime_mover, 'fuel': fuel, 'controls': list_append(controls, 'scr'), 'units': units}} END,
    CASE WHEN fuel = 'natural_gas' AND NOT list_contains(controls, 'oxidation_catalyst') AND prime_mover <> 'fuel_cell' THEN {{'label': 'add_catalyst', 'ord': 2, 'prime_mover': prime_mover, 'fuel': fuel, 'controls': list_append(controls, 'oxidation_catalyst'), 'units': units}} END,
    CASE WHEN prime_mover = 'diesel_recip' AND NOT list_contains(controls, 'tier4_final') THEN {{'label': 'tier4', 'ord': 3, 'prime_mover': prime_mover, 'fuel': fuel, 'controls': list_append(controls, 'tier4_final'), 'units': units}} END,
    CASE WHEN prime_mover = 'simple_cycle_turbine' AND fuel = 'natural_gas' THEN {{'label': 'combined_cycle', 'ord': 4, 'prime_mover': 'combined_cycle_turbine', 'fuel': fuel, 'controls': controls, 'units': units}} END,
    CASE WHEN prime_mover <> 'fuel_cell' THEN {{'label': 'fuel_cell', 'ord': 5, 'prime_mover': 'fuel_cell', 'fuel': 'natural_gas', 'controls': CAST([] AS VARCHAR[]), 'units': units}} END,
    CASE WHEN units = 1 THEN {{'label': 'split', 'ord': 6, 'prime_mover': prime_mover, 'fuel': fuel, 'controls': controls, 'units': 2}} END], lambda x: x IS NOT NULL)) AS v FROM base)),
{emissions.sql()}, chosen AS (SELECT * FROM pte), {pathway.sql('chosen.l_suppkey = located.site_id')}"""


def _variants(spark, sf_dir) -> DataFrame:
    options = emissions.estimate(variants.options(permit.at_own_site(spark, sf_dir)))
    return pathway.decide(options).withColumn("n_stops", F.size("stops"))


@registered(f"{_VARIANTS} SELECT label, count(*)::BIGINT AS n, count(*) FILTER (WHERE rank <= 2)::BIGINT AS minor, round(avg(months_likely) + 1e-7::DOUBLE, 4) AS months FROM decided GROUP BY 1")
def prj25_config_variants(spark, sf_dir):
    return _variants(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= 2).alias("minor"), shown(F.avg("months_likely")).alias("months"))


@registered(f"{_VARIANTS} SELECT plant_id, label, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY plant_id, l_suppkey ORDER BY (n_stops > 0)::INT, rank, round(months_likely, 6), ord, mw, controls) AS place FROM decided) WHERE place = 1")
def win2_best_option(spark, sf_dir):
    best = variants.first_option(_variants(spark, sf_dir), "plant_id", "l_suppkey")
    return best.select("plant_id", "label", F.lit(1).alias("place"))


_DESIGN = "plant_id, l_suppkey, mw, prime_mover, fuel, controls, run_hours, enforceable, heat_rate, units"
_BOTH = "list_concat(controls, list_filter(['scr', 'oxidation_catalyst'], lambda c: NOT list_contains(controls, c)))"


def _weighed_sql() -> str:
    """`weighed` over every plant: the plants decided as they are, then an option a row decided again."""
    scr, catalyst, simple = "list_contains(controls, 'scr')", "list_contains(controls, 'oxidation_catalyst')", "prime_mover = 'simple_cycle_turbine'"
    added = lambda control: f"list_append(controls, '{control}')"
    rows = [
        ("add_scr", f"NOT {scr}", {"controls": added("scr")}), ("add_catalyst", f"NOT {catalyst}", {"controls": added("oxidation_catalyst")}),
        ("add_both", f"NOT {scr} AND NOT {catalyst}", {"controls": _BOTH}),
        ("dry_low_nox", "contains(prime_mover, 'turbine') AND NOT list_contains(controls, 'dry_low_nox')", {"controls": added("dry_low_nox")}),
        ("combined_cycle", simple, {"prime_mover": "'combined_cycle_turbine'"}),
        ("combined_cycle_both", f"{simple} AND NOT ({scr} AND {catalyst})", {"prime_mover": "'combined_cycle_turbine'", "controls": _BOTH}),
        ("tier4", "prime_mover = 'diesel_recip' AND NOT list_contains(controls, 'tier4_final')", {"controls": added("tier4_final")}),
        ("fuel_cell", "prime_mover <> 'fuel_cell'", {"prime_mover": "'fuel_cell'", "fuel": "'natural_gas'", "controls": "CAST([] AS VARCHAR[])"}),
        ("hour_cap", "true", {}), ("hour_cap_both", f"NOT ({scr} AND {catalyst})", {"controls": _BOTH}), ("split", "units = 1 AND base_rank >= 3", {"units": "2"}),
    ]
    made = " UNION ALL ".join(
        f"SELECT plant_id, l_suppkey, mw, {', '.join(f'{held.get(c, c)} AS {c}' for c in ('prime_mover', 'fuel', 'controls'))}, run_hours, enforceable, heat_rate, "
        f"{held.get('units', 'units')} AS units, base_rank, base_months, target, '{label}' AS label, {k} AS ord FROM base WHERE {on}"
        for k, (label, on, held) in enumerate(rows)
    )
    tpy = [f"{p}_tpy" for p in POLLUTANTS]
    least = """least(threshold, CASE ozone_class WHEN 'serious' THEN 50 WHEN 'severe-15' THEN 25 WHEN 'extreme' THEN 10 ELSE CASE WHEN ozone_class IS NOT NULL THEN 100 END END,
      CASE WHEN pm25_class = 'serious' OR pm10_class = 'serious' THEN 70 END, CASE WHEN co_class = 'serious' THEN 50 END,
      CASE WHEN coalesce(pm25_class, pm10_class, co_class, so2_class, no2_class, lead_class) IS NOT NULL THEN 100 END)::DOUBLE"""
    return f"""WITH base AS (WITH {SQL['plants']}, {SQL['sites']}, {SQL['designations']}, {emissions.sql()}, chosen AS (SELECT * FROM pte), {pathway.sql('chosen.l_suppkey = located.site_id')}
  SELECT {_DESIGN}, rank AS base_rank, months_likely AS base_months, {least} AS target FROM decided),
plants AS ({made}), {SQL['sites']}, {SQL['designations']}, {emissions.sql()},
worked AS (SELECT *, greatest({', '.join(f'{p}_tpy' for p in CRITERIA)}) AS top_tpy, CASE WHEN label LIKE 'hour_cap%' THEN 8760 * target * 0.9::DOUBLE / (top_tpy * 8760 / effective_hours) END AS cap FROM pte),
chosen AS (SELECT * REPLACE ({', '.join(f'CASE WHEN cap IS NULL THEN {c} ELSE {c} * (cap / effective_hours) END AS {c}' for c in tpy)}, coalesce(cap, run_hours) AS run_hours, cap IS NOT NULL OR enforceable AS enforceable)
  FROM worked WHERE cap IS NULL OR (top_tpy >= target AND cap >= 1000)), {pathway.sql('chosen.l_suppkey = located.site_id')},
weighed AS (SELECT *, base_rank - rank AS rank_delta, base_months - months_likely AS months_saved, CASE WHEN enforceable THEN run_hours / 8760 ELSE 1 END AS availability FROM decided)"""


def _weighed(spark, sf_dir) -> DataFrame:
    return variants.weighed_in_brief(permit.at_own_site_in_brief(spark, sf_dir))


@registered(f"""{_weighed_sql()} SELECT label, count(*)::BIGINT AS n, count(*) FILTER (WHERE rank_delta > 0)::BIGINT AS better, count(*) FILTER (WHERE rank_delta < 0)::BIGINT AS worse,
count(*) FILTER (WHERE round(months_saved, 6) > 1)::BIGINT AS sooner, count(*) FILTER (WHERE n_stops > 0)::BIGINT AS stopped, max(months_saved) AS most_saved, min(availability) AS least_available FROM weighed GROUP BY 1""")
def prj25_options_in_full(spark, sf_dir):
    """All eleven options of every plant at its own site: how many there are and what they bring."""
    sooner = F.count_if(F.round("months_saved", 6) > 1).alias("sooner")
    return _weighed(spark, sf_dir).groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.col("rank_delta") > 0).alias("better"), F.count_if(F.col("rank_delta") < 0).alias("worse"), sooner,
        F.count_if(F.col("n_stops") > 0).alias("stopped"), F.max("months_saved").alias("most_saved"), F.min("availability").alias("least_available"),
    )


@registered(f"""{_weighed_sql()} SELECT plant_id, label, pathway, rank_delta, months_saved, availability FROM weighed WHERE rank_delta > 0 OR round(months_saved, 6) > 1
QUALIFY row_number() OVER (PARTITION BY plant_id, l_suppkey ORDER BY (n_stops > 0)::INT, rank_delta DESC, round(months_saved, 6) DESC, round(availability, 9) DESC, ord, mw, controls) = 1""")
def win2_improving_option(spark, sf_dir):
    """The option to take for each plant that any option improves."""
    best = variants.best_option(_weighed(spark, sf_dir), "plant_id", "l_suppkey")
    return best.select("plant_id", "label", "pathway", "rank_delta", "months_saved", "availability")


@registered(f"""{_PTE.replace(SQL['plants'], SQL['plants'].replace('plants AS', 'base AS') + ''', plants AS (SELECT * REPLACE (CASE WHEN l_suppkey % 3 = 0 THEN 'fuel_cell' ELSE prime_mover END AS prime_mover, CASE WHEN l_suppkey % 3 = 0 THEN 'natural_gas' ELSE fuel END AS fuel,
  CASE WHEN l_suppkey % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE controls END AS controls, CASE WHEN l_suppkey % 5 = 0 THEN 4000::DOUBLE ELSE run_hours END AS run_hours, l_suppkey % 5 = 0 OR enforceable AS enforceable) FROM base)''')}
SELECT plant_id, prime_mover, fuel, len(controls)::INT AS n_controls, round(nox_tpy + 1e-7::DOUBLE, 4) AS nox_tpy FROM pte""")
def prj23_overrides(spark, sf_dir):
    k = F.col("l_suppkey")
    change = F.struct(F.when(k % 3 == 0, "fuel_cell").alias("prime_mover"), F.when(k % 5 == 0, 4000.0).alias("run_hours"), F.when(k % 5 == 0, True).alias("enforceable"))
    changed = variants.overridden(derived.plants(spark, sf_dir).withColumn("change", change))
    return emissions.estimate(changed).select("plant_id", "prime_mover", "fuel", F.size("controls").alias("n_controls"), shown("nox_tpy").alias("nox_tpy"))


# ---- reasons


@registered(f"""{_OWN}, t AS (SELECT plant_id, site_id, unnest([{{'k': 'gas', 'm': CASE WHEN fuel = 'natural_gas' AND gas_pipeline_km > 25 THEN 12 WHEN fuel = 'natural_gas' AND gas_pipeline_km > 8 THEN 4 ELSE 0 END}}, {{'k': 'zoning', 'm': CASE WHEN zoning_posture = 'hostile' THEN 6 ELSE 0 END}},
  {{'k': 'ej', 'm': CASE WHEN ej THEN 4 ELSE 0 END}}, {{'k': 'litigation', 'm': CASE WHEN cases > 0 THEN 3 ELSE 0 END}}]) AS r FROM decided)
SELECT r.k AS reason, count(*)::BIGINT AS n, sum(r.m)::DOUBLE AS months FROM t WHERE r.m > 0 GROUP BY 1""")
def agg21_months_by_reason(spark, sf_dir):
    names = {"gas_reachability": "gas", "zoning_posture": "zoning", "ej_denial_authority": "ej", "litigation": "litigation"}
    months = pathway.months_by_rule(permit.fuels_at_own_site(spark, sf_dir), *names)
    reason = F.col("name")
    for old, new in names.items():
        reason = F.when(F.col("name") == old, new).otherwise(reason)
    return months.select(reason.alias("reason"), "n", "months")


@registered(f"""{_OWN} SELECT plant_id, site_id, array_to_string(list_filter([CASE WHEN NOT state IN ('VA', 'TX', 'GA', 'OH', 'AZ', 'NJ', 'NM', 'IL') THEN 'unmodelled_state' END,
  CASE WHEN coalesce(ozone_class, pm25_class, pm10_class, co_class, so2_class, no2_class, lead_class) IS NULL THEN 'no_designation' END, CASE WHEN class_i_km IS NULL THEN 'no_class_i' END,
  CASE WHEN gas_pipeline_km IS NULL THEN 'gas_unread' END], lambda x: x IS NOT NULL), ',') AS caveats FROM decided""")
def prj46_caveats(spark, sf_dir):
    return permit.own_site(spark, sf_dir).select("plant_id", "site_id", F.array_join(variants.caveats(), ",").alias("caveats"))


@registered(f"""{_OWN} SELECT plant_id, site_id, array_to_string(list_filter([CASE WHEN shaped THEN 'terrain' END, CASE WHEN shaped THEN 'class_i' END, CASE WHEN fuel = 'natural_gas' THEN 'gas' END, CASE WHEN shaped AND residents_1km > 0 THEN 'residents' END], lambda x: x IS NOT NULL), ',') AS buy
FROM (SELECT *, largest_tpy >= 0.6::DOUBLE * threshold AS shaped FROM decided)""")
def prj21_facts_to_buy(spark, sf_dir):
    return permit.own_site(spark, sf_dir).select("plant_id", "site_id", F.array_join(variants.facts_to_buy(), ",").alias("buy"))


@registered(f"{_SWEEP} SELECT pathway, n_stops, added, count(*)::BIGINT AS members, count(DISTINCT state)::BIGINT AS states, min(site_id) AS first_site FROM decided GROUP BY 1, 2, 3")
def agg18_profiles(spark, sf_dir):
    d = permit.reference_sweep(spark, sf_dir).withColumn("n_stops", F.size("stops"))
    return d.groupBy("pathway", "n_stops", "added").agg(F.count("*").alias("members"), F.countDistinct("state").alias("states"), F.min("site_id").alias("first_site"))


@registered(f"{_SWEEP} SELECT round(max(months_likely) - min(months_likely) + 1e-7::DOUBLE, 4) AS spread_months, count(*)::BIGINT AS sites FROM decided")
def agg25_geographic_spread(spark, sf_dir):
    return permit.reference_sweep(spark, sf_dir).agg(shown(F.max("months_likely") - F.min("months_likely")).alias("spread_months"), F.count("*").alias("sites"))


# ---- joins of records


@registered(f"""WITH {SQL['sites']}, posture AS (SELECT lpad((c_nationkey + 1)::VARCHAR, 2, '0') || lpad((c_custkey % 60)::VARCHAR, 3, '0') AS fips, 'County ' || (c_custkey % 60)::VARCHAR AS county, max(c_custkey) AS record FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1, 2),
named AS (SELECT county, max(record) AS record FROM posture GROUP BY 1)
SELECT s.site_id, coalesce(p.record, n.record) AS record FROM sites s LEFT JOIN posture p ON s.fips = p.fips LEFT JOIN named n ON s.county = n.county""")
def join3_posture_fallback(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_custkey % 3 > 0")
    fips = F.concat(F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"), F.lpad((F.col("c_custkey") % 60).cast("string"), 3, "0"))
    county = F.concat(F.lit("County "), (F.col("c_custkey") % 60).cast("string"))
    posture = c.groupBy(fips.alias("fips"), county.alias("county")).agg(F.max("c_custkey").alias("by_fips"))
    named = posture.groupBy("county").agg(F.max("by_fips").alias("by_name"))
    held = derived.sites(spark, sf_dir).select("site_id", "fips", "county").join(posture.select("fips", "by_fips"), "fips", "left").join(named, "county", "left")
    return held.select("site_id", F.coalesce("by_fips", "by_name").alias("record"))


@registered("""WITH d AS (SELECT p_partkey AS docket, p_name AS name FROM part), q AS (SELECT * FROM (VALUES ('ring'), ('bolt'), ('red')) AS t(term))
SELECT docket, term FROM d JOIN q ON contains(lower(name), term)""")
def flt14_docket_terms(spark, sf_dir):
    d = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("docket"), F.lower("p_name").alias("name"))
    terms = spark.range(1, numPartitions=1).select(F.explode(F.array(*[F.lit(t) for t in ("ring", "bolt", "red")])).alias("term"))
    return d.join(F.broadcast(terms), d.name.contains(terms.term)).select("docket", "term")


@registered(f"""WITH {SQL['sites']}, courts AS (SELECT * FROM (VALUES ('VA', ['vaed', 'vawd']), ('TX', ['txnd', 'txsd', 'txed', 'txwd']), ('NJ', ['njd']), ('OH', ['ohnd', 'ohsd'])) AS t(state, ids))
SELECT site_id, unnest(ids) AS court FROM sites JOIN courts ON sites.state = courts.state""")
def join18_courts(spark, sf_dir):
    rows = {"VA": ["vaed", "vawd"], "TX": ["txnd", "txsd", "txed", "txwd"], "NJ": ["njd"], "OH": ["ohnd", "ohsd"]}
    one = F.array(*[F.struct(F.lit(s).alias("state"), F.array(*[F.lit(c) for c in ids]).alias("ids")) for s, ids in rows.items()])
    courts = spark.range(1, numPartitions=1).select(F.inline(one))
    return derived.sites(spark, sf_dir).join(F.broadcast(courts), "state").select("site_id", F.explode("ids").alias("court"))


@registered("""WITH s AS (SELECT event_id AS scene, user_id AS site, ts, value AS cloud FROM events), m AS (SELECT user_id AS site, min(ts) + INTERVAL 10 DAY AS target FROM events GROUP BY 1),
r AS (SELECT s.site, scene, row_number() OVER (PARTITION BY s.site ORDER BY (date_diff('second', least(ts, target), greatest(ts, target)) // 259200), round(cloud), scene) AS place, cloud FROM s JOIN m ON s.site = m.site AND ts BETWEEN target - INTERVAL 9 DAY AND target + INTERVAL 9 DAY WHERE cloud < 60)
SELECT site, arg_min(scene, CASE WHEN cloud <= 2 THEN place ELSE 1000 + cloud * 1000 + place END) AS scene FROM r WHERE place <= 10 GROUP BY 1""")
def win9_scene_pick(spark, sf_dir):
    return variants.scene_pick(read(spark, sf_dir, "events"))


@registered("""WITH h AS (SELECT d.source AS county, max(CASE WHEN toxic = 1 THEN 2 ELSE 1 - quality END) AS expected FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1),
s AS (SELECT source AS county, CASE WHEN count(*) FILTER (WHERE contains(lower(text), 'worthless') OR contains(lower(text), 'loser')) >= 2 THEN 2 WHEN count(*) >= 40 THEN 1 ELSE 0 END AS heard FROM documents GROUP BY 1)
SELECT h.county, expected, heard, CASE WHEN heard > expected THEN 'hotter' WHEN heard < expected THEN 'cooler' ELSE 'agrees' END AS verdict FROM h JOIN s ON h.county = s.county""")
def join20_reconciled(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("county"), "text")
    mark = F.when(F.col("toxic") == 1, 2).otherwise(1 - F.col("quality"))
    hand = read(spark, sf_dir, "labels").join(d.select("doc_id", "county"), "doc_id").groupBy("county").agg(F.max(mark).alias("expected"))
    loud = F.count_if(news.mentions("text", ("worthless", "loser")))
    heard = d.groupBy("county").agg(F.when(loud >= 2, 2).when(F.count("*") >= 40, 1).otherwise(0).alias("heard"))
    verdict = F.when(F.col("heard") > F.col("expected"), "hotter").when(F.col("heard") < F.col("expected"), "cooler").otherwise("agrees")
    return hand.join(heard, "county").withColumn("verdict", verdict)


# ---- feeds that arrive as text


@registered("""WITH f AS (SELECT c_custkey AS fips, c_name AS name, c_acctbal AS land FROM customer WHERE c_custkey % 10 <> 9) SELECT lpad(fips::VARCHAR, 5, '0') AS fips, name, CASE WHEN fips % 10 = 3 THEN 0.0::DOUBLE ELSE land END AS land FROM f""")
def src1_gazetteer(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    k, sep = F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, "|").otherwise("\t")
    land = F.when(k % 10 == 3, "").otherwise(F.col("c_acctbal").cast("string"))
    line = F.when(k % 10 == 9, F.concat(k.cast("string"), sep, F.lit("short"))).otherwise(F.concat(F.lpad(k.cast("string"), 5, "0"), sep, F.lit(" "), F.col("c_name"), sep, land))
    return feeds.gazetteer(c.select(line.alias("line")))


@registered("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice / l_quantity + 1e-7::DOUBLE, 4) AS usd FROM lineitem WHERE l_quantity >= 2 AND l_tax >= 0.02""")
def src11_offer_book(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    body = F.to_json(F.struct(F.col("l_quantity").alias("num_gpus"), F.col("l_extendedprice").alias("dph_total"), F.col("l_tax").alias("gpu_ram")))
    offers = feeds.offers(li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", body.alias("body")), least_gpus=2, least_ram=0.02)
    return offers.withColumn("usd", shown("usd"))


@registered("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, len(text)::BIGINT AS n FROM conversations)
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN n END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS header FROM t""")
def win6_header_carried(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.col("role") == "user", F.char_length("text").cast("long")), True).over(order)
    return c.select("conv_id", "turn", "role", header.alias("header"))


@registered("""SELECT user_id, count(*)::BIGINT AS rows, max(event_id) AS last_event FROM events WHERE event_id % 50 <> 7 GROUP BY 1""")
def src21_resume_log(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 50 == 7, F.concat(F.lit('{"user_id": '), F.col("user_id").cast("string"))).otherwise(F.to_json(F.struct("user_id", "event_id")))
    log = feeds.json_lines(e.select(line.alias("line")), "user_id long, event_id long")
    return log.groupBy("user_id").agg(F.count("*").alias("rows"), F.max("event_id").alias("last_event"))


@registered("""WITH b AS (SELECT event_id, CASE WHEN value < 5 THEN -4 WHEN value < 20 THEN -2 WHEN value < 60 THEN 0 ELSE 3 END AS tone, event_type FROM events)
SELECT event_type, round(avg(tone) + 1e-7::DOUBLE, 4) AS mean_tone, round(avg((tone <= -2)::INT) + 1e-7::DOUBLE, 4) AS negative FROM b GROUP BY 1""")
def agg16_tone(spark, sf_dir):
    tone = F.when(F.col("value") < 5, -4).when(F.col("value") < 20, -2).when(F.col("value") < 60, 0).otherwise(3)
    bins = read(spark, sf_dir, "events").groupBy("event_type", tone.alias("tone")).agg(F.count("*").alias("n"))
    g = bins.groupBy("event_type")
    mean, low = F.sum(F.col("tone") * F.col("n")) / F.sum("n"), F.sum(F.when(F.col("tone") <= -2, F.col("n")).otherwise(0)) / F.sum("n")
    return g.agg(shown(mean).alias("mean_tone"), shown(low).alias("negative"))


# ---- text, date and unit forms


@registered(r"""SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(replace(lower(replace(p_name || ' & St. ' || p_type || ' COUNTY', '&', ' and ')), 'st. ', 'saint '), ' (county|parish|borough)$', ''), '[^a-z0-9]+', ' ', 'g')) AS folded, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g') AS slug,
  regexp_replace(trim(regexp_replace(p_name || '   ROAD', '\s+', ' ', 'g')), '\s+$', '') AS address FROM part""")
def scl_s2_folded_names(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit(" & St. "), "p_type", F.lit(" COUNTY"))
    return p.select(F.col("p_partkey").alias("id"), forms.folded(name).alias("folded"), forms.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), forms.one_spaced(F.concat("p_name", F.lit("   ROAD"))).alias("address"))


@registered("""SELECT o_orderkey AS id, CASE WHEN abs(v) >= 1e9 THEN 'B' WHEN abs(v) >= 1e6 THEN 'M' WHEN abs(v) >= 1e3 THEN 'k' ELSE '' END AS tier, round(v / CASE WHEN abs(v) >= 1e9 THEN 1e9 WHEN abs(v) >= 1e6 THEN 1e6 WHEN abs(v) >= 1e3 THEN 1e3 ELSE 1 END + 1e-7::DOUBLE, 1) AS amount FROM (SELECT *, o_totalprice * power(10::DOUBLE, (o_orderkey % 6 - 3)::DOUBLE) AS v FROM orders)""")
def scl_s11_usd_tiers(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("v", F.col("o_totalprice") * F.pow(F.lit(10.0), (F.col("o_orderkey") % 6 - 3).cast("double")))
    tier, amount = forms.usd_tier(F.col("v"))
    return o.select(F.col("o_orderkey").alias("id"), tier.alias("tier"), shown(amount, 1).alias("amount"))


@registered("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * CASE l_returnflag WHEN 'A' THEN 1.609344 WHEN 'N' THEN 0.001 ELSE 0.0003048 END + 1e-7::DOUBLE, 6) AS km FROM lineitem""")
def scl_m7_units(spark, sf_dir):
    unit = F.when(F.col("l_returnflag") == "A", "mi").when(F.col("l_returnflag") == "N", "m").otherwise("ft")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shown(forms.kilometres(F.col("l_quantity"), unit), 6).alias("km"))


@registered("""SELECT o_orderkey AS id, round(date_diff('day', o_orderdate::DATE, DATE '2002-01-01') / 30.4375::DOUBLE + 1e-7::DOUBLE, 4) AS since, date_diff('day', o_orderdate::DATE, DATE '1998-01-01') > 0 AS passed FROM orders""")
def prj39_schedule_block(spark, sf_dir):
    since, passed = forms.schedule(F.to_date("o_orderdate"), "2002-01-01", "1998-01-01")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), shown(since).alias("since"), passed.alias("passed"))


@registered(f"""WITH {SQL['sites']}, u AS (SELECT site_id, radians(lat) AS p, radians(lon - (floor((lon + 180) / 6) * 6 - 177)) AS l, floor((lon + 180) / 6)::INT + 1 AS zone FROM sites),
t AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - 0.0066943799901413165::DOUBLE * power(sin(p), 2)) AS n, power(tan(p), 2) AS t, 0.006739496742276434::DOUBLE * power(cos(p), 2) AS c, l * cos(p) AS a FROM u)
SELECT site_id, zone, round(500000 + 0.9996::DOUBLE * n * (a + (1 - t + c) * power(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * 0.006739496742276434::DOUBLE) * power(a, 5) / 120) + 1e-7::DOUBLE, 2) AS easting FROM t""")
def scl_m4_utm(spark, sf_dir):
    zone, easting = forms.utm_easting(F.col("lat"), F.col("lon"))
    return derived.sites(spark, sf_dir).select("site_id", zone.alias("zone"), shown(easting, 2).alias("easting"))


@registered("""SELECT c_custkey AS id, CASE c_mktsegment WHEN 'MACHINERY' THEN 0.9::DOUBLE WHEN 'FURNITURE' THEN 0.6::DOUBLE WHEN 'HOUSEHOLD' THEN 0.3::DOUBLE END AS confidence, coalesce(CASE c_mktsegment WHEN 'MACHINERY' THEN 0.9::DOUBLE WHEN 'FURNITURE' THEN 0.6::DOUBLE WHEN 'HOUSEHOLD' THEN 0.3::DOUBLE END >= 0.5, false) AS accepted FROM customer""")
def flt4_geocode_acceptance(spark, sf_dir):
    confidence = forms.looked_up(F.col("c_mktsegment"), {"MACHINERY": 0.9, "FURNITURE": 0.6, "HOUSEHOLD": 0.3})
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), confidence.alias("confidence"), F.coalesce(confidence >= 0.5, F.lit(False)).alias("accepted"))


# ---- set operations and SQL functions


@registered(f"""{_OWN}, o AS (SELECT l_orderkey, list_sort(list_distinct(list(pathway))) AS names, arg_min(pathway, plant_id) AS first FROM decided GROUP BY 1)
SELECT l_orderkey AS project, array_to_string(list_filter(names, lambda n: n <> first), ',') AS added FROM o""")
def set3_pathways_added(spark, sf_dir):
    d = permit.own_site(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("pathway")).alias("names"), F.min_by("pathway", "plant_id").alias("first"))
    return d.select(F.col("l_orderkey").alias("project"), F.array_join(F.array_except("names", F.array("first")), ",").alias("added"))


@registered("""SELECT name, count(*)::BIGINT AS sources FROM (SELECT DISTINCT 'n' || n_regionkey AS name, 1 AS s FROM nation UNION ALL SELECT DISTINCT 'n' || (s_nationkey % 7), 2 FROM supplier UNION ALL SELECT DISTINCT 'n' || (c_nationkey % 9), 3 FROM customer) GROUP BY 1""")
def set2_preset_fields(spark, sf_dir):
    parts = [("nation", "n_regionkey"), ("supplier", "s_nationkey % 7"), ("customer", "c_nationkey % 9")]
    named = [read(spark, sf_dir, t).select(F.concat(F.lit("n"), F.expr(f"cast({e} as string)")).alias("name")).distinct() for t, e in parts]
    return named[0].unionByName(named[1]).unionByName(named[2]).groupBy("name").agg(F.count("*").alias("sources"))


@registered("""WITH a AS (SELECT c_custkey % 500 AS k, 'old' AS src, c_acctbal AS v, c_custkey AS o FROM customer UNION ALL SELECT s_suppkey, 'new', s_acctbal, s_suppkey + 1000000000 FROM supplier) SELECT k, arg_max(src, o) AS src, arg_max(v, o) AS v FROM a GROUP BY 1""")
def set6_fact_merge(spark, sf_dir):
    old = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 500).alias("k"), F.lit("old").alias("src"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("o"))
    new = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("new").alias("src"), F.col("s_acctbal").alias("v"), (F.col("s_suppkey") + 1_000_000_000).alias("o"))
    return old.unionByName(new).groupBy("k").agg(F.max_by("src", "o").alias("src"), F.max_by("v", "o").alias("v"))


@registered(f"""WITH {SQL['sites']} SELECT site_id, round({"2 * 6371.0088::DOUBLE * asin(least(1.0::DOUBLE, sqrt(power(sin(radians(39 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(39.0::DOUBLE)) * power(sin(radians(-77 - lon) / 2), 2))))"} + 1e-7::DOUBLE, 4) AS km FROM sites""")
def udf3_sql_function(spark, sf_dir):
    forms.register_sql(spark)
    derived.sites(spark, sf_dir).createOrReplaceTempView("airgate_sites")
    return spark.sql("SELECT site_id, round(airgate_km(lat, lon, 39.0D, -77.0D) + 1e-7D, 4) AS km FROM airgate_sites")
