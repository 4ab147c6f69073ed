"""Registered jobs on nested bodies, made of customers, events, suppliers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgate.plans.base import registered, shown
from airgate.sources import bodies
from airgate.sources.derived import read

# ---- the price index of a page: two machines a customer, up to six days, some without a trade, some pages cut off


def _pages(spark, sf_dir) -> DataFrame:
    # Dealt out while rows are a key each: a table of one row group is read by one task, which would make and search all pages.
    c, k = read(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism), F.col("c_custkey")
    point = lambda m: lambda d: F.concat(
        F.lit('{"date":"$D2024-03-0'), (d + 1).cast("string"), F.lit('T00:00:00Z","avg":'), F.when((k + d + m) % 4 == 0, F.lit("0")).otherwise(((k * (m + 2) % 900 + d + 1) / 4).cast("string")),
        F.when((k + d) % 3 == 0, F.concat(F.lit(',"bottom":'), ((d + 1) / 8).cast("string"), F.lit(',"top":'), (k % 50 + 1000).cast("string"), F.lit(',"book":{"depth":{"n":1}}'))).otherwise(F.lit("")), F.lit("}"),
    )
    series = lambda m: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), (k % 6).cast("int")), point(m)), ","), F.lit("]"))
    whole = F.concat(F.lit('{"title":"{x} \\"index\\"","data":{"pricesByHardwareType": {"h100":'), series(0), F.lit(',"b200":'), series(1), F.lit("}}} trailing } {"))
    escaped = F.replace(F.replace(whole, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    body = F.when(k % 17 == 0, "<html>no prices</html>").when(k % 19 == 0, F.substring(escaped, 1, 80)).otherwise(F.concat(F.lit('<script>push("'), escaped, F.lit('")</script>')))
    return c.select(k.alias("page"), body.alias("body"))


_POINTS = """points AS (SELECT c_custkey AS page, hardware, d::INT AS pos, '2024-03-0' || (d + 1) AS day, CASE WHEN (c_custkey + d + m) % 4 = 0 THEN 0 ELSE (c_custkey * (m + 2) % 900 + d + 1) / 4 END::DOUBLE AS avg,
  (c_custkey + d) % 3 = 0 AS ranged, c_custkey FROM (SELECT *, unnest(range(0, c_custkey % 6 + 1)) AS d FROM customer), (VALUES ('h100', 0), ('b200', 1)) AS h(hardware, m) WHERE c_custkey % 17 <> 0 AND c_custkey % 19 <> 0),
ranged AS (SELECT page, hardware, pos, day, avg, CASE WHEN ranged THEN (pos + 1) / 8::DOUBLE ELSE avg END AS low, CASE WHEN ranged THEN (c_custkey % 50 + 1000)::DOUBLE ELSE avg END AS high, avg > 0 AS traded FROM points)"""


@registered(f"WITH {_POINTS} SELECT * FROM ranged")
def src12_index_points(spark, sf_dir):
    return bodies.index_points(_pages(spark, sf_dir))


@registered(f"""WITH {_POINTS} SELECT page, hardware, arg_min(avg, pos) AS usd, arg_min(low, pos) AS low, arg_min(high, pos) AS high, arg_min(day, pos) AS day, count(*)::BIGINT AS n_traded, arg_max(avg, pos) AS first_usd
FROM ranged WHERE traded GROUP BY 1, 2""")
def src12_index_quotes(spark, sf_dir):
    return bodies.index_quotes(bodies.index_points(_pages(spark, sf_dir)))


# ---- requests: the same one with its keys in three orders and noise in the eighth place


def _requests(spark, sf_dir) -> DataFrame:
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    number = lambda x: F.format_string("%.8f", x)
    noise = (k % 3 - 1) * 3e-8
    lat, lon = number(30 + F.col("user_id") / 8 + noise), number(-100 - F.col("user_id") / 16 + noise)
    kind = F.concat(F.lit('"type":"'), F.col("event_type"), F.lit(' \\"2.50000001\\" é"'))
    tags = F.concat(F.lit('"tags": ["b", 2, "a", ['), (F.col("user_id") % 5).cast("string"), F.lit(', 1.0, {"z":null,"y":true}]]'))
    point = F.when(k % 2 == 0, F.concat(F.lit('"point": {"lat": '), lat, F.lit(', "lon": '), lon, F.lit("}"))).otherwise(F.concat(F.lit('"point":{"lon":'), lon, F.lit(',"lat":'), lat, F.lit("}")))
    orders = [(kind, tags, point), (point, kind, tags), (tags, point, kind)]
    body = F.when(F.lit(False), "")
    for n, parts in enumerate(orders):
        body = body.when(k % 3 == n, F.concat(F.lit("{ "), parts[0], F.lit(", "), parts[1], F.lit(","), parts[2], F.lit("}")))
    return e.select("event_id", F.concat(F.lit("v1/"), F.col("event_type")).alias("endpoint"), body.alias("body"))


@registered("""WITH e AS (SELECT event_id, event_type, user_id, regexp_replace(printf('%.6f', 30 + user_id / 8::DOUBLE), '\\.?0+$', '') AS lat, regexp_replace(printf('%.6f', -100 - user_id / 16::DOUBLE), '\\.?0+$', '') AS lon FROM events)
SELECT event_id, sha256('v1/' || event_type || chr(0) || '{"point":{"lat":' || lat || ',"lon":' || lon || '},"tags":["b",2,"a",[' || (user_id % 5) || ',1,{"y":true,"z":null}]],"type":"' || event_type || ' \\"2.50000001\\" é"}') AS key FROM e""")
def scl_j1_response_keys(spark, sf_dir):
    rows = _requests(spark, sf_dir)
    return rows.select("event_id", bodies.response_key(F.col("endpoint"), F.col("body")).alias("key"))


# ---- lookups of suppliers


@registered("""WITH s AS (SELECT *, s_suppkey % 4 <> 3 AS has_parcel FROM supplier),
f AS (SELECT s_suppkey AS site_id, unnest([
  {'fact': 'county_fips', 'value': lpad(s_suppkey::VARCHAR, 5, '0'), 'unit': NULL, 'source': 'lookup'}, {'fact': 'county', 'value': s_name, 'unit': NULL, 'source': 'lookup'},
  {'fact': 'state', 'value': CASE WHEN s_suppkey % 7 <> 0 THEN 'S' || s_nationkey END, 'unit': NULL, 'source': 'lookup'}, {'fact': 'within_floodplain', 'value': (s_suppkey % 2 = 0)::VARCHAR, 'unit': NULL, 'source': 'lookup'},
  {'fact': 'elevation_m', 'value': (s_suppkey % 90)::VARCHAR, 'unit': 'meters', 'source': 'lookup'},
  {'fact': 'county_market.rent', 'value': CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey * 3)::VARCHAR END, 'unit': NULL, 'source': 'county_market'},
  {'fact': 'county_market.trend', 'value': '{"q1":' || (s_suppkey % 3) || '}', 'unit': NULL, 'source': 'county_market'},
  {'fact': CASE WHEN has_parcel THEN 'parcel.apn' END, 'value': 'P-' || s_suppkey, 'unit': NULL, 'source': CASE WHEN s_suppkey % 3 = 0 THEN 'assessor' ELSE 'parcel' END},
  {'fact': CASE WHEN has_parcel THEN 'parcel.area_m2' END, 'value': (s_suppkey * 10)::VARCHAR, 'unit': 'm2', 'source': CASE WHEN s_suppkey % 3 = 0 THEN 'assessor' ELSE 'parcel' END},
  {'fact': CASE WHEN has_parcel AND s_suppkey % 3 = 0 THEN 'parcel.source' END, 'value': 'assessor', 'unit': NULL, 'source': 'assessor'},
  {'fact': CASE WHEN NOT has_parcel THEN 'parcel.unavailable_reason' END, 'value': 'no_match', 'unit': NULL, 'source': 'lookup'}]) AS x FROM s)
SELECT site_id, x.fact AS fact, x.value AS value, x.unit AS unit, x.source AS source FROM f WHERE x.fact IS NOT NULL AND (x.value IS NOT NULL OR x.fact LIKE 'county_market.%')""")
def src17_lookup_facts(spark, sf_dir):
    k = F.col("s_suppkey")
    market = F.struct(F.when(k % 5 != 0, k * 3).alias("rent"), F.struct((k % 3).alias("q1")).alias("trend"))
    parcel = F.struct(F.concat(F.lit("P-"), k.cast("string")).alias("apn"), (k * 10).alias("area_m2"), F.lit(None).cast("string").alias("zoning"), F.when(k % 3 == 0, "assessor").alias("source"), F.lit("POLYGON").alias("geometry_wkt"))
    body = F.struct(
        F.lpad(k.cast("string"), 5, "0").alias("county_fips"), F.col("s_name").alias("county"), F.when(k % 7 != 0, F.concat(F.lit("S"), F.col("s_nationkey").cast("string"))).alias("state"), (k % 2 == 0).alias("within_floodplain"),
        (k % 90).alias("elevation_m"), F.lit("resolved").alias("disposition"), market.alias("county_market"), F.when(k % 4 != 3, parcel).alias("parcel"), (k % 4 == 3).alias("parcel_unavailable"),
        F.when(k % 4 == 3, "no_match").alias("parcel_unavailable_reason"),
    )
    rows = read(spark, sf_dir, "supplier").select(k.alias("site_id"), F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
    return bodies.lookup_facts(rows)


# ---- batches of eight orders; some entries fail, are missing, stand twice or have an index that is none


@registered("""SELECT o_orderkey // 8 AS batch, (o_orderkey % 8)::INT AS place, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN o_custkey END AS customer FROM orders""")
def src16_aligned_batches(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.expr("o_orderkey div 8").alias("batch"), (F.col("o_orderkey") % 8).cast("int").alias("place"), "o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    one = lambda index, ok, value: F.concat(F.lit('{"index":'), index, F.lit(',"ok":'), ok.cast("string"), F.lit(',"fields":{"customer":{"value":'), value.cast("string"), F.lit("}}}"))
    right = F.when(k % 7 != 0, one(F.col("place").cast("string"), k % 5 != 0, F.col("o_custkey")))
    # Another entry for the same place comes first, and ones that belong to no place.
    stale, stray = F.when((k % 11 == 0) & (k % 7 != 0), one(F.col("place").cast("string"), F.lit(True), F.lit(-1))), F.when(k % 13 == 0, one(F.lit('"x"'), F.lit(True), F.lit(-2)))
    beyond = F.when(k % 3 == 0, one(F.lit("99"), F.lit(True), F.lit(-3)))
    entry = F.concat_ws(",", stray, stale, beyond, right)
    made = o.groupBy("batch").agg(F.array_join(F.filter(F.collect_list(entry), lambda x: x != ""), ",").alias("list"))
    found = bodies.batch_results(o, made.select("batch", F.concat(F.lit('{"results":['), F.col("list"), F.lit("]}")).alias("body")))
    return found.select("batch", "place", "o_orderkey", "status", F.get_json_object(F.col("fields")["customer"], "$.value").cast("long").alias("customer"))
