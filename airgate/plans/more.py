"""Registered jobs on parsed feeds, reasons and deltas, filters, record joins, sinks and further forms."""

from __future__ import annotations

import uuid
from itertools import takewhile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgate.functions import forms, rules
from airgate.operators import pathway, records
from airgate.plans import permit
from airgate.plans.base import registered, shown
from airgate.plans.permit import _OWN, _SWEEP
from airgate.sources import derived, feeds
from airgate.sources.derived import SQL, read
from airgate.streaming.jobs import _folder

# ---- feeds: bodies are made from the given tables by Spark, then parsed


@registered("""SELECT user_id, ts::DATE::VARCHAR AS day, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def src8_daily_series(spark, sf_dir):
    days = read(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyyMMdd").alias("date")).agg(F.count("*").alias("value"))
    # A user's series has a point a day at most.
    body = F.to_json(F.struct(F.array(F.struct(F.collect_list(F.struct("date", "value")).alias("data"))).alias("timeline")))
    return feeds.series(days.groupBy("user_id").agg(body.alias("body")), "user_id")


@registered("""SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) <> '' AS titled, regexp_extract(url, '://([^/?#]*)', 1) AS publication FROM pages WHERE url IS NOT NULL""")
def src10_feed_items(spark, sf_dir):
    title = F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1))
    safe = F.regexp_replace(F.regexp_replace(title, "&[a-z]*;?", " "), "[<>&]", " ")
    item = F.concat(F.lit("<item><title>"), safe, F.lit(" .</title><link>"), F.regexp_replace("url", "&", "&amp;"), F.lit("</link></item>"))
    return feeds.rss_items(read(spark, sf_dir, "pages").where("url is not null").select("page_id", item.alias("item"))).select("page_id", (F.length("title") > 1).alias("titled"), "publication")


@registered("""SELECT c_custkey AS page, k AS gpu_class, round(c_acctbal / k + 1e-7::DOUBLE, 4) AS usd FROM customer, (SELECT unnest(range(1, 4)) AS k) WHERE c_acctbal / k > 0 AND c_custkey % 4 <> k""")
def src12_embedded_index(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    prices = F.to_json(F.create_map(*[x for k in (1, 2, 3) for x in (F.lit(str(k)), F.when(F.col("c_custkey") % 4 == k, 0.0).otherwise(F.col("c_acctbal") / k))]))
    page = F.concat(F.lit('<script>var x = {"pricesByHardwareType":'), prices, F.lit("};</script>"))
    return feeds.embedded_prices(c.select(F.col("c_custkey").alias("page"), page.alias("body"))).withColumn("usd", shown("usd"))


@registered("""SELECT p_partkey AS page, p_brand AS label, least(p_retailprice, p_size::DOUBLE) AS low, greatest(p_retailprice, p_size::DOUBLE) AS high FROM part WHERE p_size > 0""")
def src14_rate_table(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    cell = lambda x: F.concat(F.lit("<td>$"), F.format_string("%.2f", x), F.lit("</td>"))
    row = F.concat(F.lit("<table><tr><td><b>"), F.col("p_brand"), F.lit("</b></td>"), cell(F.col("p_retailprice")), cell(F.col("p_size").cast("double")), F.lit("</tr></table>"))
    return feeds.rate_rows(p.where("p_size > 0").select(F.col("p_partkey").alias("page"), row.alias("body")))


@registered("""SELECT o_custkey AS batch, (o_orderkey % 3)::INT AS place, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS value, o_orderkey FROM orders""")
def src16_batch_results(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    result = F.to_json(F.struct((F.col("o_orderkey") % 3).cast("int").alias("index"), (F.col("o_orderkey") % 5 != 0).alias("ok"), F.col("o_totalprice").alias("value")))
    held = o.select(F.col("o_custkey").alias("batch"), "o_orderkey", F.from_json(result, "index int, ok boolean, value double").alias("r"))
    return held.select("batch", F.col("r.index").alias("place"), F.when(F.col("r.ok"), F.col("r.value")).alias("value"), "o_orderkey")


@registered("""SELECT s_suppkey AS site, key, value FROM supplier UNPIVOT (value FOR key IN (balance, nation, odd)) """.replace("FROM supplier UNPIVOT", "FROM (SELECT s_suppkey, s_acctbal AS balance, s_nationkey::DOUBLE AS nation, (s_suppkey % 2)::DOUBLE AS odd FROM supplier) UNPIVOT"))
def src17_flattened_lookup(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"), (F.col("s_suppkey") % 2).cast("double").alias("odd"))
    return s.unpivot("site", ["balance", "nation", "odd"], "key", "value")


# ---- imagery grids and clouds


_CELLS = """cells AS (SELECT vec_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""


def _cells(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return e.select("vec_id", F.expr("pos div 8").alias("r"), (F.col("pos") % 8).cast("long").alias("c"), F.col("v").cast("double").alias("v"))


@registered(f"""WITH {_CELLS}, coarse AS (SELECT vec_id, r // 2 AS r2, c // 2 AS c2, max(v) AS w FROM cells GROUP BY 1, 2, 3)
SELECT a.vec_id, round(sum(a.v * b.w) + 1e-7::DOUBLE, 4) AS joined FROM cells a JOIN coarse b ON a.vec_id = b.vec_id AND a.r // 2 = b.r2 AND a.c // 2 = b.c2 GROUP BY 1""")
def join11_coarse_band(spark, sf_dir):
    fine = _cells(spark, sf_dir).withColumns({"r2": F.expr("r div 2"), "c2": F.expr("c div 2")})
    coarse = fine.groupBy("vec_id", "r2", "c2").agg(F.max("v").alias("w"))
    return fine.join(coarse, ["vec_id", "r2", "c2"]).groupBy("vec_id").agg(shown(F.sum(F.col("v") * F.col("w"))).alias("joined"))


@registered(f"""WITH {_CELLS}, k AS (SELECT vec_id, abs(floor(v * 40)::BIGINT) % 12 AS scl FROM cells) SELECT vec_id, round(avg((scl IN (3, 8, 9, 10))::INT) + 1e-7::DOUBLE, 4) AS cloud, round(avg((scl NOT IN (0, 1, 3, 8, 9, 10, 11))::INT) + 1e-7::DOUBLE, 4) AS usable,
  avg((scl IN (3, 8, 9, 10))::INT) <= 0.10 AND avg((scl NOT IN (0, 1, 3, 8, 9, 10, 11))::INT) >= 0.60 AS accepted, count(DISTINCT scl)::BIGINT AS classes FROM k GROUP BY 1""")
def agg13_cloud_share(spark, sf_dir):
    k = _cells(spark, sf_dir).withColumn("scl", F.abs(F.floor(F.col("v") * 40)) % 12)
    cloud, usable = F.avg(F.col("scl").isin(3, 8, 9, 10).cast("int")), F.avg((~F.col("scl").isin(0, 1, 3, 8, 9, 10, 11)).cast("int"))
    return k.groupBy("vec_id").agg(shown(cloud).alias("cloud"), shown(usable).alias("usable"), ((cloud <= 0.10) & (usable >= 0.60)).alias("accepted"), F.countDistinct("scl").alias("classes"))


# ---- reasons and deltas


@registered(f"""{_OWN}, t AS (SELECT plant_id, site_id, 1 + (coalesce(ozone_class, pm25_class, pm10_class, co_class, so2_class, no2_class, lead_class) IS NOT NULL)::INT AS place, pathway AS name FROM decided) SELECT name, place::INT AS place, count(*)::BIGINT AS n FROM t GROUP BY 1, 2""")
def prj18_reasoning_chain(spark, sf_dir):
    """Where the pathway stands in each chain of reasons."""
    # The rules that come before the pathway's are on the site alone.
    before = list(takewhile(lambda rule: rule[0] != rules.PATHWAYS[0][0], pathway.RULES))
    place = F.expr(" + ".join(["1", *(f"if({fires}, 1, 0)" for _, fires, _ in before)])).alias("place")
    d = pathway.planned_in_brief(permit.at_own_site_in_brief(spark, sf_dir, place))
    counts = d.groupBy("rank", "place").agg(F.count("*").alias("n"))
    return counts.select(F.element_at(F.array(*[F.lit(p[0]) for p in rules.PATHWAYS]), F.col("rank") + 1).alias("name"), "place", "n")


_STEPS = (
    ("nonattainment_designation", "coalesce(ozone_class, pm25_class, pm10_class, co_class, so2_class, no2_class, lead_class) IS NOT NULL"),
    ("class_i_aqrv", "class_i_km <= 300"), ("psd_increment_consumed", "increment_no2 >= 0.5"), ("psd_increment_consumed", "increment_pm25 >= 0.5"),
    ("title_v", "largest_tpy >= 100 OR hcho_tpy >= 10"), ("nsps_turbine", "contains(prime_mover, 'turbine')"), ("nsps_rice", "contains(prime_mover, 'recip')"),
    ("state_toxics", "state_toxics"), ("ozone_transport_region", "otr"), ("ej_denial_authority", "ej"), ("complex_terrain", "terrain_relief_m > 150"),
    ("county_moratorium", "moratorium"), ("zoning_posture", "zoning_posture = 'hostile'"), ("litigation", "cases > 0"),
    ("gas_reachability", "fuel = 'natural_gas' AND gas_pipeline_km > 8"), ("source_aggregation_risk", "units > 1"),
)
_SAID = [f"CASE WHEN {fires} THEN '+' ELSE '-' END || '{name} [{rules.CITATIONS[name]}]'" for name, fires in _STEPS]
_LAW = " ".join(f"WHEN '{p[0]}' THEN '{rules.CITATIONS[p[0]]}'" for p in rules.PATHWAYS)
_SAID.insert(1, f"'+' || pathway || ' [' || CASE pathway {_LAW} END || ']'")


@registered(f"""{_OWN} SELECT plant_id, site_id, {" || '; ' || ".join(_SAID)} AS reasons FROM decided""")
def prj18_reasons_in_order(spark, sf_dir):
    """The whole chain of each assessment in one text: fired (+) and unfired (-) steps in order, each with its citation."""
    said = lambda r: F.concat(F.when(r["fired"], "+").otherwise("-"), r["name"], F.lit(" ["), r["citation"], F.lit("]"))
    return permit.own_site(spark, sf_dir).select("plant_id", "site_id", F.array_join(F.transform(pathway.reasons(), said), "; ").alias("reasons"))


@registered(f"""{_OWN}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY site_id, plant_id) AS seq FROM decided), p AS (SELECT l_orderkey, rank, months_likely, n_stops, plant_id FROM o WHERE seq <= 2)
SELECT l_orderkey AS project, (max(rank) FILTER (WHERE plant_id = lo) - max(rank) FILTER (WHERE plant_id = hi))::INT AS rank_delta FROM (SELECT *, min(plant_id) OVER (PARTITION BY l_orderkey) AS lo, max(plant_id) OVER (PARTITION BY l_orderkey) AS hi FROM p) GROUP BY 1""")
def prj24_pathway_delta(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("site_id", "plant_id")
    d = permit.own_site(spark, sf_dir).select("l_orderkey", "plant_id", "site_id", "rank").withColumn("seq", F.row_number().over(order)).where("seq <= 2")
    ends = d.groupBy("l_orderkey").agg(F.min(F.struct("plant_id", (-F.col("rank")).alias("r"))).alias("lo"), F.max(F.struct("plant_id", F.col("rank").alias("r"))).alias("hi"))
    return ends.select(F.col("l_orderkey").alias("project"), (-F.col("lo.r") - F.col("hi.r")).alias("rank_delta"))


@registered()
def prj24_candidate_deltas(spark, sf_dir):
    """All of an order's plants after the first; prj24_pathway_delta has the second's rank only."""
    return pathway.deltas(permit.own_site(spark, sf_dir), "l_orderkey")


@registered(f"""{_SWEEP} SELECT site_id, array_to_string(list_transform(list_sort(list_filter([struct_pack(m := -(CASE WHEN rank = 4 THEN 6 ELSE 0 END)::DOUBLE, n := 'major_nonattainment_nsr'), struct_pack(m := -(CASE WHEN class_i_km <= 100 THEN 6 WHEN class_i_km <= 300 THEN 2 ELSE 0 END)::DOUBLE, n := 'class_i_aqrv'),
  struct_pack(m := -(CASE WHEN zoning_posture = 'hostile' THEN 6 ELSE 0 END)::DOUBLE, n := 'zoning_posture'), struct_pack(m := -(CASE WHEN gas_pipeline_km > 25 THEN 12 WHEN gas_pipeline_km > 8 THEN 4 ELSE 0 END)::DOUBLE, n := 'gas_reachability'), struct_pack(m := -(CASE WHEN ej THEN 4 ELSE 0 END)::DOUBLE, n := 'ej_denial_authority')], lambda x: x.m < 0))[1:3], lambda x: x.n), ',') AS top FROM decided""")
def top3_deciding_factors(spark, sf_dir):
    kept = ("major_nonattainment_nsr", "class_i_aqrv", "zoning_posture", "gas_reachability", "ej_denial_authority")
    held = F.filter("triggers", lambda t: (t["months"] > 0) & t["name"].isin(*kept))
    ranked = F.slice(F.array_sort(F.transform(held, lambda t: F.struct((-t["months"]).alias("m"), t["name"].alias("n")))), 1, 3)
    return permit.reference_sweep(spark, sf_dir).select("site_id", F.array_join(F.transform(ranked, lambda x: x["n"]), ",").alias("top"))


@registered(f"""{_SWEEP}, k AS (SELECT site_id, dense_rank() OVER (ORDER BY pathway, n_stops, added) AS profile FROM decided) SELECT profile::INT AS profile, count(*)::BIGINT AS sites, min(site_id) AS first_site FROM k GROUP BY 1""")
def join22_profile_index(spark, sf_dir):
    """Profiles are few; they are numbered after they are collapsed, and the number joins back on the profile."""
    d = permit.reference_sweep(spark, sf_dir).select("site_id", "pathway", F.size("stops").alias("n_stops"), "added")
    keys = ["pathway", "n_stops", "added"]
    numbered = d.select(*keys).distinct().withColumn("profile", F.dense_rank().over(Window.orderBy(*keys)))
    return d.join(numbered, keys).groupBy("profile").agg(F.count("*").alias("sites"), F.min("site_id").alias("first_site"))


@registered("""WITH v AS (SELECT o_orderkey % 7 AS case_id, o_orderkey, o_orderpriority AS variant, o_totalprice / 10000 AS months FROM orders)
SELECT case_id, round(arg_min(months, o_orderkey) + 1e-7::DOUBLE, 4) AS base, round(arg_max(months, o_orderkey) + 1e-7::DOUBLE, 4) AS last, round(arg_max(months, o_orderkey) - arg_min(months, o_orderkey) + 1e-7::DOUBLE, 4) AS delta, count(*)::BIGINT AS variants FROM v GROUP BY 1""")
def agg23_backtest_grades(spark, sf_dir):
    v = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("case_id"), "o_orderkey", (F.col("o_totalprice") / 10000).alias("months"))
    first, last = F.min_by("months", "o_orderkey"), F.max_by("months", "o_orderkey")
    return v.groupBy("case_id").agg(shown(first).alias("base"), shown(last).alias("last"), shown(last - first).alias("delta"), F.count("*").alias("variants"))


@registered("""WITH r AS (SELECT o_orderkey AS project, o_totalprice / (1 + o_custkey % 9) AS implied, 100000 AS quoted FROM orders) SELECT project, round(implied / quoted + 1e-7::DOUBLE, 4) AS ratio, implied / quoted BETWEEN 0.33 AND 3.0 AS passes FROM r""")
def prj29_contract_check(spark, sf_dir):
    ratio = F.col("o_totalprice") / (1 + F.col("o_custkey") % 9) / 100000
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project"), shown(ratio).alias("ratio"), ratio.between(0.33, 3.0).alias("passes"))


@registered("""WITH m AS (SELECT o_orderkey AS project, o_totalprice * least(6, o_custkey % 10) AS config, o_totalprice * least(12, o_custkey % 17) AS site FROM orders) SELECT project, CASE WHEN site > config THEN 'site' ELSE 'config' END AS best, round(greatest(config, site) + 1e-7::DOUBLE, 2) AS usd FROM m""")
def top6_best_mitigation(spark, sf_dir):
    c, price = F.col("o_custkey"), F.col("o_totalprice")
    routes = F.array(F.struct((price * F.least(F.lit(6), c % 10)).alias("usd"), F.lit(0).alias("o"), F.lit("config").alias("name")), F.struct((price * F.least(F.lit(12), c % 17)).alias("usd"), F.lit(-1).alias("o"), F.lit("site").alias("name")))
    best = F.array_max(routes)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project"), best["name"].alias("best"), shown(best["usd"], 2).alias("usd"))


# ---- facts and requests


@registered("""WITH f AS (SELECT user_id AS site, event_type || '_' || (event_id % 3)::VARCHAR AS key, event_id AS ord, value FROM events), h AS (SELECT * FROM (VALUES ('gas_km', 'click'), ('terrain_m', 'view_1'), ('residents', 'purchase')) AS t(target, hint))
SELECT site, target, arg_min(value, ord) AS value FROM f JOIN h ON contains(lower(key), hint) GROUP BY 1, 2""")
def prj45_facts_to_columns(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.concat("event_type", F.lit("_"), (F.col("event_id") % 3).cast("string")).alias("key"), F.col("event_id").alias("ord"), "value")
    return records.hinted(e, {"gas_km": "click", "terrain_m": "view_1", "residents": "purchase"})


@registered("""WITH a AS (SELECT user_id AS request, event_type AS ask, event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 9 END AS rank FROM events) SELECT request, arg_min(ask, rank * 10000000000 + event_id) AS outcome FROM a GROUP BY 1""")
def prj47_request_outcome(spark, sf_dir):
    rank = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(9)
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("request")).agg(F.min_by("event_type", F.struct(rank, "event_id")).alias("outcome"))


@registered("""SELECT user_id AS run, (count(DISTINCT event_type) * count(*) * 1 + count(DISTINCT ts::DATE) * 36)::BIGINT AS credits FROM events GROUP BY 1""")
def prj44_cost_forecast(spark, sf_dir):
    fields, calls, days = F.countDistinct("event_type"), F.count("*"), F.countDistinct(F.to_date("ts"))
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg((fields * calls + days * 36).alias("credits"))


@registered("""SELECT c_custkey AS id, (2 - (c_custkey % 3 = 0)::INT)::BIGINT AS billable, c_custkey % 2 = 0 AS overlaps FROM customer""")
def set4_billable_fields(spark, sf_dir):
    k = F.col("c_custkey")
    asked = F.array_compact(F.array(F.lit("slope"), F.when(k % 3 != 0, "gas"), F.when(k % 2 == 0, "owner")))
    group = F.array(F.lit("owner"), F.lit("parcel_id"))
    return read(spark, sf_dir, "customer").select(k.alias("id"), F.size(F.array_except(asked, group)).cast("long").alias("billable"), F.arrays_overlap(asked, group).alias("overlaps"))


@registered("""SELECT DISTINCT event_type AS name FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')""")
def flt2_unknown_labels(spark, sf_dir):
    """The labels that no known one matches; a strict run fails on any of them."""
    known = spark.range(1, numPartitions=1).select(F.explode(F.array(F.lit("click"), F.lit("view"), F.lit("purchase"))).alias("name"))
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct().join(F.broadcast(known), "name", "left_anti")


@registered("""SELECT page_id, CASE WHEN status BETWEEN 200 AND 299 OR (status BETWEEN 400 AND 499 AND status NOT IN (401, 403, 408, 429)) THEN 'kept' ELSE 'dropped' END AS cached FROM (SELECT page_id, [200, 204, 404, 401, 429, 500, 301, 422][(page_id % 8 + 1)::INT] AS status FROM pages)""")
def flt16_cacheable(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 204, 404, 401, 429, 500, 301, 422)]), (F.col("page_id") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", F.when(records.cacheable(status), "kept").otherwise("dropped").alias("cached"))


@registered(r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^(www|m|blog)\.', '') AS host FROM pages) SELECT page_id FROM h WHERE host NOT IN ('spam-farm.example.org', 'cheap-pills.example.com', 'casino-win.example.com')""")
def flt10_local_pages(spark, sf_dir):
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), r"^(www|m|blog)\.", "")
    national = spark.range(1, numPartitions=1).select(F.explode(F.array(*[F.lit(h) for h in ("spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.com")])).alias("host"))
    return read(spark, sf_dir, "pages").select("page_id", host.alias("host")).join(F.broadcast(national), "host", "left_anti").select("page_id")


@registered(r"""SELECT o_orderkey AS id, len(regexp_extract_all('plan in ' || o_orderpriority || ' County and County ' || o_custkey::VARCHAR || ' County', '[A-Z0-9][A-Za-z0-9-]* County'))::INT AS named FROM orders""")
def flt9_counties_named(spark, sf_dir):
    said = F.concat(F.lit("plan in "), F.col("o_orderpriority"), F.lit(" County and County "), F.col("o_custkey").cast("string"), F.lit(" County"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.size(F.regexp_extract_all(said, F.lit(r"[A-Z0-9][A-Za-z0-9-]* County"), 0)).alias("named"))


@registered(f"""WITH {SQL['sites']} SELECT site_id, term FROM sites, (SELECT unnest(['county 1', 'loudoun', 'tx']) AS term) WHERE contains(lower(county || ', ' || state), term)""")
def join16_reference_contracts(spark, sf_dir):
    terms = spark.range(1, numPartitions=1).select(F.explode(F.array(*[F.lit(t) for t in ("county 1", "loudoun", "tx")])).alias("term"))
    place = derived.sites(spark, sf_dir).select("site_id", F.lower(F.concat_ws(", ", "county", "state")).alias("place"))
    return place.join(F.broadcast(terms), F.col("place").contains(F.col("term"))).select("site_id", "term")


@registered("""SELECT o_orderkey AS project, coalesce(c.c_nationkey, o_orderkey % 25) AS state, c.c_nationkey IS NULL AS unverified FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey""")
def join23_declared_jurisdiction(spark, sf_dir):
    resolved = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("state"))
    held = read(spark, sf_dir, "orders").join(resolved, "o_custkey", "left")
    return held.select(F.col("o_orderkey").alias("project"), F.coalesce("state", F.col("o_orderkey") % 25).alias("state"), F.col("state").isNull().alias("unverified"))


@registered("""WITH d AS (SELECT o_orderkey AS docket, o_custkey % 40 AS court, o_orderdate AS filed, row_number() OVER (PARTITION BY o_custkey, o_custkey % 40 ORDER BY o_orderkey) AS seen FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY court ORDER BY filed DESC, docket) AS place FROM d WHERE seen = 1)
SELECT court, docket FROM f WHERE place <= 20""")
def top4_newest_dockets(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("docket"), "o_custkey", (F.col("o_custkey") % 40).alias("court"), F.col("o_orderdate").alias("filed"))
    first = o.groupBy("o_custkey", "court").agg(F.min_by(F.struct("docket", "filed"), "docket").alias("d")).select("court", "d.*")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("court").orderBy(F.desc("filed"), "docket"))).where("place <= 20").select("court", "docket")


# ---- sinks


@registered("""SELECT state, count(*)::BIGINT AS n, round(sum(km) + 1e-7::DOUBLE, 2) AS km FROM (SELECT s_nationkey::BIGINT AS state, s_acctbal AS km FROM supplier) GROUP BY 1""")
def snk1_score_table(spark, sf_dir):
    """The table written by state and read back."""
    path = f"{_folder(spark)}/scores"
    read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("state"), F.col("s_acctbal").alias("km")).write.partitionBy("state").parquet(path)
    return spark.read.schema("km double, state long").parquet(path).groupBy("state").agg(F.count("*").alias("n"), shown(F.sum("km"), 2).alias("km"))


@registered("""SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_type <> 'view' GROUP BY 1""")
def snk2_append_progress(spark, sf_dir):
    path = f"{_folder(spark)}/progress"
    e = read(spark, sf_dir, "events").select("event_type", "event_id")
    for part in ("event_type = 'click'", "event_type not in ('click', 'view')"):
        e.where(part).write.mode("append").parquet(path)
    return spark.read.schema("event_type string, event_id long").parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@registered(f"""{_OWN} SELECT plant_id, site_id, pathway, added FROM decided""")
def snk3_assessment_json(spark, sf_dir):
    """Assessments as nested JSON lines, written and read back."""
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    permit.own_site(spark, sf_dir).select(F.to_json(F.struct("plant_id", "site_id", "pathway", "added", "triggers", "stops")).alias("value")).write.option("compression", "gzip").text(path)
    held = spark.read.text(path).select(F.from_json("value", "plant_id string, site_id long, pathway string, added double").alias("r"))
    return held.select("r.*")


# ---- further forms


@registered(r"""SELECT c_custkey AS id, regexp_replace(name, ' (County|Parish|Borough|city)$', '') AS bare, CASE WHEN regexp_matches(state, '^[0-9]{2}') THEN 'fips' WHEN regexp_matches(state, '^[A-Z]{2}$') THEN 'code' ELSE '??' END AS how
FROM (SELECT c_custkey, c_mktsegment || [' County', ' Parish', ' city', ''][(c_custkey % 4 + 1)::INT] AS name, ['VA', '51153', 'somewhere'][(c_custkey % 3 + 1)::INT] AS state FROM customer)""")
def scl_s1_county_names(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.concat("c_mktsegment", F.element_at(F.array(*[F.lit(s) for s in (" County", " Parish", " city", "")]), (k % 4 + 1).cast("int")))
    state = F.element_at(F.array(*[F.lit(s) for s in ("VA", "51153", "somewhere")]), (k % 3 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(k.alias("id"), forms.bare_county(name).alias("bare"), forms.state_kind(state).alias("how"))


@registered(r"""SELECT p_partkey AS id, lower(regexp_extract(said, '\(([^)]*)\)\s*$', 1)) AS grade, CASE WHEN contains(lower(said), 'ozone') THEN 'ozone' WHEN contains(lower(said), 'pm-2.5') THEN 'pm25' END AS pollutant, regexp_replace(said, '<[^>]+>', '', 'g') AS plain
FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '8-Hour Ozone <b>' ELSE 'PM-2.5 <b>' END || p_name || '</b> (' || p_type || ')' AS said FROM part)""")
def scl_s7_classification_text(spark, sf_dir):
    said = F.concat(F.when(F.col("p_size") % 2 == 0, "8-Hour Ozone <b>").otherwise("PM-2.5 <b>"), F.col("p_name"), F.lit("</b> ("), F.col("p_type"), F.lit(")"))
    grade, pollutant = forms.classification(said)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), grade.alias("grade"), pollutant.alias("pollutant"), forms.untagged(said).alias("plain"))


@registered("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 12)::BIGINT::VARCHAR || ' MW' || CASE WHEN l_linenumber > 3 THEN ', capped' ELSE '' END AS signature FROM lineitem""")
def scl_s10_config_signature(spark, sf_dir):
    signature = F.concat(F.round(F.col("l_quantity") * 12).cast("long").cast("string"), F.lit(" MW"), F.when(F.col("l_linenumber") > 3, ", capped").otherwise(""))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", signature.alias("signature"))


@registered("""SELECT s_suppkey AS id, round(CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE lat END + 1e-7::DOUBLE, 3) AS lat, round(CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE lon END + 1e-7::DOUBLE, 3) AS lon FROM (SELECT s_suppkey, s_acctbal / 1000 AS lat, -s_nationkey::DOUBLE AS lon FROM supplier)""")
def scl_s14_coordinates(spark, sf_dir):
    said = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("near "), F.col("s_name"))).otherwise(F.concat((F.col("s_acctbal") / 1000).cast("string"), F.lit(" , "), (-F.col("s_nationkey")).cast("string")))
    lat, lon = forms.coordinates(said)
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), shown(lat, 3).alias("lat"), shown(lon, 3).alias("lon"))


@registered("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate::DATE::VARCHAR END AS day FROM orders""")
def scl_d1_compact_dates(spark, sf_dir):
    said = F.when(F.col("o_orderkey") % 6 == 0, "20261399").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.try_to_timestamp(said, F.lit("yyyyMMdd")).cast("date").cast("string").alias("day"))


@registered("""SELECT event_id, strftime(ts::DATE, '%Y-%m-%d') || ' 00:00:00' AS opens, strftime(ts::DATE, '%Y-%m-%d') || ' 23:59:59' AS closes FROM events""")
def scl_d5_day_window(spark, sf_dir):
    start = F.date_trunc("day", F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("opens"), F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit(" 23:59:59")).alias("closes"))


@registered(f"""WITH {SQL['sites']}, c AS (SELECT site_id, radians(lat) AS p, radians(lon + 96) AS l, (sin(radians(29.5::DOUBLE)) + sin(radians(45.5::DOUBLE))) / 2 AS n FROM sites), d AS (SELECT *, power(cos(radians(29.5::DOUBLE)), 2) + 2 * n * sin(radians(29.5::DOUBLE)) AS k FROM c)
SELECT site_id, round(sqrt(k - 2 * n * sin(p)) / n * sin(n * l) + 1e-7::DOUBLE, 6) AS x, round(sqrt(k - 2 * n * sin(radians(37.5::DOUBLE))) / n - sqrt(k - 2 * n * sin(p)) / n * cos(n * l) + 1e-7::DOUBLE, 6) AS y FROM d""")
def scl_m6_albers(spark, sf_dir):
    x, y = forms.albers(F.col("lat"), F.col("lon"))
    return derived.sites(spark, sf_dir).select("site_id", shown(x, 6).alias("x"), shown(y, 6).alias("y"))


@registered("""SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.missing.deep'), 'absent') AS deep, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'absent' WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 THEN 'yes' ELSE 'no' END AS tri FROM events""")
def scl_j2_nested_get(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    tri = F.when(k.isNull(), "absent").when(k > 50, "yes").otherwise("no")
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(k, F.lit(-1).cast("long")).alias("k"), F.coalesce(F.get_json_object("props", "$.missing.deep"), F.lit("absent")).alias("deep"), tri.alias("tri"))
