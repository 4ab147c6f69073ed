"""Registered jobs on stops, stored designations, JSON records and the remaining forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from airgate.functions import forms
from airgate.functions.rules import SIGNIFICANT
from airgate.operators import providers
from airgate.plans import permit
from airgate.plans.base import registered, shown
from airgate.plans.permit import _OWN
from airgate.sources import derived, feeds
from airgate.sources.derived import SQL, read


@registered(f"""{_OWN} SELECT plant_id, site_id, array_to_string(list_filter([CASE WHEN offset_ratio >= 1.3 THEN 'offsets' END, CASE WHEN increment_no2 >= 0.95 THEN 'increment_no2' END, CASE WHEN increment_pm25 >= 0.95 THEN 'increment_pm25' END,
  CASE WHEN ej AND residents_1km > 500 THEN 'ej_residents' END, CASE WHEN moratorium THEN 'moratorium' END, CASE WHEN fuel = 'natural_gas' AND gas_pipeline_km > 25 THEN 'gas' END], lambda x: x IS NOT NULL), ',') AS stops FROM decided""")
def prj14_hard_stops(spark, sf_dir):
    return permit.own_site(spark, sf_dir).select("plant_id", "site_id", F.array_join("stops", ",").alias("stops"))


@registered(f"""{_OWN} SELECT plant_id, site_id, CASE WHEN major THEN concat_ws(',', {', '.join(f"CASE WHEN {p}_tpy >= {r!r} THEN '{p}' END" for p, r in SIGNIFICANT.items())}) ELSE '' END AS bact FROM decided""")
def prj16_bact_list(spark, sf_dir):
    return permit.own_site(spark, sf_dir).select("plant_id", "site_id", F.array_join("bact", ",").alias("bact"))


@registered(f"""{_OWN} SELECT rank, CASE WHEN otr THEN 3 ELSE 0 END + CASE WHEN ej THEN 4 ELSE 0 END + CASE WHEN state_toxics THEN 2 ELSE 0 END AS state_months, count(*)::BIGINT AS n, sum(added)::DOUBLE AS added FROM decided GROUP BY 1, 2""")
def prj13_trigger_months(spark, sf_dir):
    state = F.aggregate(F.filter("triggers", lambda t: t["name"].isin("ozone_transport_region", "ej_denial_authority", "state_toxics")), F.lit(0.0), lambda s, t: s + t["months"])
    return permit.own_site(spark, sf_dir).groupBy("rank", state.cast("int").alias("state_months")).agg(F.count("*").alias("n"), F.sum("added").alias("added"))


@registered(f"""WITH {SQL['designations']} SELECT fips, count(*)::BIGINT AS n, array_to_string(list_sort(list(pollutant || ':' || classification || ':' || row_id::VARCHAR)), ',') AS held FROM designations WHERE nonattain = 'Yes' GROUP BY 1""")
def src4_designation_store(spark, sf_dir):
    """The designations of each county as one record; a county has a handful."""
    d = derived.designations(spark, sf_dir).where("nonattain = 'Yes'")
    line = F.concat_ws(":", "pollutant", "classification", F.col("row_id").cast("string"))
    return d.groupBy("fips").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(line)), ",").alias("held"))


@registered("""WITH r AS (SELECT c_custkey, lpad((c_custkey % 700)::VARCHAR, 5, '0') AS fips, c_mktsegment AS posture FROM customer) SELECT c_custkey AS record, CASE WHEN posture NOT IN ('MACHINERY', 'FURNITURE', 'HOUSEHOLD') THEN 'posture' WHEN count(*) OVER (PARTITION BY fips) > 1 THEN 'duplicate' ELSE 'ok' END AS verdict FROM r""")
def src6_posture_records(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    body = F.to_json(F.struct(F.col("c_custkey").alias("record"), F.lpad((F.col("c_custkey") % 700).cast("string"), 5, "0").alias("fips"), F.col("c_mktsegment").alias("posture")))
    return feeds.validated_posture(c.select(body.alias("body")), ("MACHINERY", "FURNITURE", "HOUSEHOLD"))


@registered("""SELECT page_id, left(trim(regexp_replace(coalesce(nullif(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), ''), 'cause'), '\\s+', ' ', 'g')), 400) AS snippet, CASE WHEN url IS NULL THEN NULL ELSE 'https://courts.example.org/' || page_id::VARCHAR END AS url FROM pages""".replace("\\\\", "\\"))
def src7_dockets(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    body = F.to_json(
        F.struct(
            F.array(F.struct(F.lit("").alias("snippet")), F.struct(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("snippet"))).alias("recap_documents"),
            F.lit("cause").alias("cause"), F.when(F.col("url").isNotNull(), F.concat(F.lit("/"), F.col("page_id").cast("string"))).alias("docket_absolute_url"),
        )
    )
    return feeds.dockets(p.select("page_id", body.alias("body")), "https://courts.example.org")


@registered("""SELECT doc_id AS id, strftime(DATE '2024-01-01' + (doc_id % 90)::INT, '%Y-%m-%d') AS seen, contains(lower(split_part(text, chr(10), 1)), 'the') AS county_named FROM documents WHERE doc_id % 9 <> 4""")
def src9_articles(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    k = F.col("doc_id")
    url = F.when(k % 9 != 4, F.concat(F.lit("https://news.example.org/"), k.cast("string")))
    seen = F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 90).cast("int")), "yyyyMMdd"), F.lit("T000000Z"))
    article = F.struct(url.alias("url"), F.concat(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(" ")).alias("title"), seen.alias("seendate"))
    return feeds.articles(d.select(k.alias("id"), F.to_json(F.struct(F.array(article).alias("articles"))).alias("body")), "the")


@registered("""SELECT p_partkey AS type, least(CASE WHEN p_size > 5 THEN p_size::DOUBLE END, p_retailprice) AS low, greatest(CASE WHEN p_size > 5 THEN p_size::DOUBLE END, p_retailprice) AS high FROM part""")
def src13_rate_cards(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    body = F.to_json(F.struct(F.array(F.struct(F.col("p_partkey").alias("displayName"), F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).otherwise(0.0).alias("securePrice"), F.col("p_retailprice").alias("communityPrice"))).alias("types")))
    return feeds.rate_cards(p.select(body.alias("body")))


@registered("""SELECT event_id AS scene, round(value + 1e-7::DOUBLE, 4) AS cloud, (32600 + user_id % 60)::INT AS epsg FROM events WHERE user_id % 4 <> 1 AND event_id % 6 <> 5""")
def src18_scenes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    epsg = F.when(F.col("user_id") % 4 != 1, (32600 + F.col("user_id") % 60).cast("int"))
    assets = F.create_map(F.lit("red"), F.lit("r.tif"), F.when(F.col("event_id") % 6 == 5, "other").otherwise("nir"), F.lit("n.tif"))
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.col("value").alias("cloud"), epsg.alias("epsg")).alias("properties"), assets.alias("assets")))
    return feeds.scenes(e.select(body.alias("body")), ("red", "nir")).withColumn("cloud", shown("cloud"))


@registered("""WITH c AS (SELECT source AS county, count(*) AS stories, count(*) FILTER (WHERE n_chars > 1500) AS local FROM documents GROUP BY 1) SELECT county, CASE WHEN stories = 0 THEN 'none' WHEN stories % 5 = 0 THEN 'low' WHEN local >= 5 AND stories >= 10 THEN 'high' WHEN stories >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM c""")
def prj41_signal_confidence(spark, sf_dir):
    c = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("county")).agg(F.count("*").alias("stories"), F.count_if(F.col("n_chars") > 1500).alias("local"))
    partial = F.col("stories") % 5 == 0
    said = F.when(F.col("stories") == 0, "none").when(partial, "low").when((F.col("local") >= 5) & (F.col("stories") >= 10), "high").when(F.col("stories") >= 3, "medium").otherwise("low")
    return c.select("county", said.alias("confidence"))


@registered("""SELECT c_custkey AS candidate, CASE WHEN c_custkey % 8 = 0 OR c_acctbal < 0 THEN 'unresolved' ELSE 'read' END AS state FROM customer""")
def flt5_unread_candidates(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate"), F.when(F.col("c_custkey") % 8 != 0, F.col("c_nationkey")).alias("state_key"), F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("fips"))
    return c.select("candidate", F.when(F.col("state_key").isNull() | F.col("fips").isNull(), "unresolved").otherwise("read").alias("state"))


@registered("""SELECT doc_id AS item FROM documents WHERE contains(lower(text), 'the') AND (contains(lower(text), 'that') OR contains(lower(text), 'tion'))""")
def flt15_county_and_term(spark, sf_dir):
    low = F.lower("text")
    return read(spark, sf_dir, "documents").where(low.contains("the") & (low.contains("that") | low.contains("tion"))).select(F.col("doc_id").alias("item"))


@registered("""SELECT doc_id AS item, (DATE '2024-01-01' + (doc_id % 120)::INT)::VARCHAR AS published FROM documents WHERE DATE '2024-01-01' + (doc_id % 120)::INT >= DATE '2024-03-01'""")
def flt11_window_start(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 120).cast("int"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), day.alias("d")).where(F.col("d") >= F.lit("2024-03-01").cast("date")).select("item", F.col("d").cast("string").alias("published"))


@registered("""WITH known AS (SELECT 'n' || n_nationkey AS name FROM nation WHERE n_regionkey < 3 UNION SELECT 's' || (s_suppkey % 40) FROM supplier), asked AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey ELSE 's' || (c_custkey % 60) END AS name FROM customer)
SELECT c_custkey AS request, name FROM asked WHERE name IN (SELECT name FROM known)""")
def set7_known_fields(spark, sf_dir):
    named = lambda t, letter, e, on="true": read(spark, sf_dir, t).where(on).select(F.concat(F.lit(letter), F.expr(f"cast({e} as string)")).alias("name"))
    known = named("nation", "n", "n_nationkey", "n_regionkey < 3").union(named("supplier", "s", "s_suppkey % 40")).distinct()
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit("s"), (k % 60).cast("string")))
    return read(spark, sf_dir, "customer").select(k.alias("request"), name.alias("name")).join(known, "name", "left_semi").select("request", "name")


@registered("""SELECT s_suppkey AS id, replace(replace(regexp_replace('&micro;g/m<sup>' || s_nationkey || '</sup>', '<[^>]+>', '', 'g'), '&micro;', 'µ'), '&amp;', '&') AS unit, CASE WHEN s_nationkey = 0 THEN 'Parish' WHEN s_nationkey = 1 THEN 'Borough' ELSE 'County' END AS label FROM supplier""")
def scl_s8_units_and_labels(spark, sf_dir):
    raw = F.concat(F.lit("&micro;g/m<sup>"), F.col("s_nationkey").cast("string"), F.lit("</sup>"))
    label = F.when(F.col("s_nationkey") == 0, "Parish").when(F.col("s_nationkey") == 1, "Borough").otherwise("County")
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), forms.unescaped(forms.untagged(raw)).alias("unit"), label.alias("label"))


@registered("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def scl_d4_mail_dates(spark, sf_dir):
    said = F.concat(F.date_format("o_orderdate", "dd MMM yyyy"), F.lit(" 00:00:00"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(F.try_to_timestamp(said, F.lit("dd MMM yyyy HH:mm:ss")), "yyyy-MM-dd").alias("day"))


@registered("""SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus)))[1:3], ',') AS kinds, bool_or(l_tax > 0.07) AS any_high, bool_and(l_tax > 0.01) AS all_taxed FROM lineitem GROUP BY 1""")
def scl_a1_array_forms(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("k"), F.bool_or(F.col("l_tax") > 0.07).alias("any_high"), F.bool_and(F.col("l_tax") > 0.01).alias("all_taxed"))
    return li.select("l_orderkey", F.array_join(F.slice(F.array_sort("k"), 1, 3), ",").alias("kinds"), "any_high", "all_taxed")


@registered("""WITH f AS (SELECT user_id AS site_id, event_type AS key, value FROM events WHERE event_type IN ('click', 'view')), s AS (SELECT DISTINCT user_id AS site_id FROM events) SELECT s.site_id, count(f.key)::BIGINT AS facts, CASE WHEN count(DISTINCT f.key) = 2 THEN 'complete' ELSE 'incomplete' END AS state FROM s LEFT JOIN f ON s.site_id = f.site_id GROUP BY 1""")
def udf1_fact_provider(spark, sf_dir):
    """Any table of the facts schema serves as a provider; sites that it says nothing about come out incomplete, not clean."""
    e = read(spark, sf_dir, "events")
    facts = e.where(F.col("event_type").isin("click", "view")).select(F.col("user_id").alias("site_id"), F.col("event_type").alias("key"), "value")
    return providers.coverage(e.select(F.col("user_id").alias("site_id")).distinct(), facts, ("click", "view"))


@registered("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY (role <> 'user')::INT, len(text) DESC, turn, text) AS place FROM conversations) SELECT conv_id, turn, role, place::INT AS place FROM r WHERE place <= 2""")
def win15_top_two_reasons(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy((F.col("role") != "user").cast("int"), F.desc(F.char_length("text")), "turn", "text")
    return read(spark, sf_dir, "conversations").withColumn("place", F.row_number().over(order)).where("place <= 2").select("conv_id", "turn", "role", "place")
