"""Registered jobs on news, records, imagery, facts and accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgate.operators import news, raster, records
from airgate.plans.base import registered, shown
from airgate.sources.derived import read

# ---- news: the first line of a document is a headline, its source a county


_NEWS = """news AS (SELECT doc_id AS item_id, source AS county, lang AS publication, split_part(text, chr(10), 1) AS headline, DATE '2024-01-01' + (doc_id % 120)::INT AS published, text AS body FROM documents)"""


def _news(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        k.alias("item_id"), F.col("source").alias("county"), F.col("lang").alias("publication"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("headline"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 120).cast("int")).alias("published"), F.col("text").alias("body"),
    )


_HAS = lambda terms: " OR ".join(f"contains(lower(body), '{t}')" for t in terms)


@registered(f"""WITH {_NEWS}, c AS (SELECT county, count(*)::BIGINT AS stories, count(*) FILTER (WHERE publication = 'en')::BIGINT AS local, count(*) FILTER (WHERE {_HAS(news.ACTION)})::BIGINT AS action,
  count(*) FILTER (WHERE {_HAS(news.OPPOSITION)})::BIGINT AS opposition, count(*) FILTER (WHERE {_HAS(news.PROCEEDING)})::BIGINT AS proceeding FROM news GROUP BY 1)
SELECT *, CASE WHEN action >= 2 AND proceeding >= 1 THEN 'formal' WHEN stories >= 3 AND opposition >= 2 THEN 'organised' WHEN stories >= 2 THEN 'interest' ELSE 'quiet' END AS posture, stories < 30 AS thin_media FROM c""")
def agg11_story_counts(spark, sf_dir):
    return news.county_signal(_news(spark, sf_dir))


@registered(f"""WITH {_NEWS}, d AS (SELECT county, published AS day, count(*) AS n FROM news GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY county ORDER BY day) AS i, count(*) OVER (PARTITION BY county) AS size FROM d),
h AS (SELECT county, max(size)::BIGINT AS days, coalesce(sum(n) FILTER (WHERE i <= size // 2), 0)::BIGINT AS first_half, coalesce(sum(n) FILTER (WHERE i > size // 2), 0)::BIGINT AS second_half FROM o GROUP BY 1)
SELECT *, CASE WHEN days < 4 OR first_half = 0 THEN 'unknown' WHEN second_half / first_half::DOUBLE >= 1.5 THEN 'rising' WHEN second_half / first_half::DOUBLE <= 0.67 THEN 'falling' ELSE 'steady' END AS direction FROM h""")
def agg10_volume_halves(spark, sf_dir):
    return news.volume_trend(_news(spark, sf_dir))


@registered(f"""WITH {_NEWS}, d AS (SELECT county, published AS day, count(*) AS n FROM news GROUP BY 1, 2)
SELECT county, day::VARCHAR AS day, sum(n) OVER (PARTITION BY county ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)::BIGINT AS trailing FROM d""")
def win12_trailing_volume(spark, sf_dir):
    days = _news(spark, sf_dir).groupBy("county", F.col("published").alias("day")).agg(F.count("*").alias("n"))
    window = Window.partitionBy("county").orderBy(F.unix_date("day")).rangeBetween(-30, 0)
    return days.select("county", F.col("day").cast("string").alias("day"), F.sum("n").over(window).alias("trailing"))


@registered(rf"""WITH {_NEWS}, t AS (SELECT item_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(headline), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: len(w) > 2)) AS words FROM news)
SELECT item_id, array_to_string(list_sort(words), ' ') AS tokens FROM t""")
def scl_s4_headline_tokens(spark, sf_dir):
    return _news(spark, sf_dir).select("item_id", F.array_join(F.array_sort(news.tokens(F.col("headline"))), " ").alias("tokens"))


@registered(rf"""WITH {_NEWS}, t AS (SELECT item_id, county, published, list_distinct(list_filter(string_split(trim(regexp_replace(lower(headline), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: len(w) > 2)) AS w FROM news)
SELECT a.item_id AS a, b.item_id AS b FROM t a JOIN t b ON a.county = b.county AND a.item_id < b.item_id AND len(a.w) > 0 AND len(b.w) > 0 AND abs(a.published - b.published) <= 14
  AND 10 * len(list_intersect(a.w, b.w)) >= 6 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""")
def join15_similar_stories(spark, sf_dir):
    return news.similar(_news(spark, sf_dir))


@registered()
def agg12_story_clusters(spark, sf_dir):
    return news.stories(_news(spark, sf_dir))


_LINKED = f"""{_NEWS}, dated AS (SELECT n.* REPLACE (CASE WHEN item_id % 11 <> 0 THEN published END AS published), u.url, split_part(body, chr(10), 2) AS summary FROM news n LEFT JOIN (SELECT page_id, min(url) AS url FROM pages GROUP BY 1) u ON u.page_id = n.item_id)"""


def _dated(spark, sf_dir) -> DataFrame:
    """The news with the page of the same number as url, the second line as summary, and every eleventh item undated."""
    urls = read(spark, sf_dir, "pages").groupBy(F.col("page_id").alias("item_id")).agg(F.min("url").alias("url"))
    # The summary is taken before the join, so that bodies stay where they are read.
    held = _news(spark, sf_dir).withColumn("summary", F.split_part("body", F.lit("\n"), F.lit(2))).join(urls, "item_id", "left")
    return held.withColumn("published", F.when(F.col("item_id") % 11 != 0, F.col("published")))


@registered(rf"""WITH {_LINKED}, t AS (SELECT item_id, county, published, trim(regexp_replace(lower(headline), '[^a-z0-9]+', ' ', 'g')) AS h,
  regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '/+$', '') AS u FROM dated),
w AS (SELECT *, list_distinct(list_filter(string_split(h, ' '), lambda w: len(w) > 2)) AS w FROM t)
SELECT a.item_id AS a, b.item_id AS b FROM w a JOIN w b ON a.county = b.county AND a.item_id < b.item_id AND (a.u = b.u OR a.h = b.h OR (len(a.w) > 0 AND len(b.w) > 0 AND coalesce(abs(a.published - b.published) <= 14, true)
  AND 10 * len(list_intersect(a.w, b.w)) >= 6 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))))""")
def join15_story_links(spark, sf_dir):
    return news.same_story(_dated(spark, sf_dir))


@registered()
def agg12_story_leads(spark, sf_dir):
    return news.story_leads(_dated(spark, sf_dir))


@registered(f"""WITH {_NEWS}, r AS (SELECT county, item_id, published, row_number() OVER (PARTITION BY county ORDER BY published DESC NULLS LAST, item_id) AS place FROM news) SELECT county, item_id, published::VARCHAR AS published FROM r WHERE place <= 25""")
def top5_newest_stories(spark, sf_dir):
    newest = Window.partitionBy("county").orderBy(F.desc_nulls_last("published"), "item_id")
    return _news(spark, sf_dir).withColumn("place", F.row_number().over(newest)).where("place <= 25").select("county", "item_id", F.col("published").cast("string").alias("published"))


@registered(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '/+$', '') AS canonical FROM pages""")
def scl_s5_canonical_url(spark, sf_dir):
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.lower(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)), "/+$", "")
    return read(spark, sf_dir, "pages").select("page_id", F.concat(host, path).alias("canonical"))


@registered(r"""WITH u AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS place FROM u) SELECT host, page_id FROM r WHERE place = 1""")
def win7_first_seen(spark, sf_dir):
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), r"^www\.", "")
    return read(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.min("page_id").alias("page_id"))


@registered(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '\s+', ' ', 'g')) AS heading, len(regexp_extract_all(html, '<li>'))::BIGINT AS items, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs FROM pages""")
def src5_page_rows(spark, sf_dir):
    heading = F.trim(F.regexp_replace(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), r"\s+", " "))
    return read(spark, sf_dir, "pages").select("page_id", heading.alias("heading"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@registered("""WITH l AS (SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus, o_orderpriority,
  count(*) OVER w + sum(l_linenumber % 2) OVER w AS place, last_value(CASE WHEN l_linenumber % 2 = 1 THEN 'County ' || l_suppkey END IGNORE NULLS) OVER w AS county
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag, l_linestatus ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey AS page, place::INT AS row, upper(o_orderpriority) AS state, county, 'Area ' || l_partkey AS area, l_returnflag <> 'R' AS whole, l_linestatus AS designation, l_returnflag AS status FROM l""")
def src5_designation_rows(spark, sf_dir):
    """Each order as a page: its priority the state, suppliers of odd lines the counties, lines the designations."""
    cell = lambda *said: F.concat(F.lit("<td>"), *said, F.lit("</td>"))
    county = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("<tr>"), cell(F.lit("County "), F.col("l_suppkey")), F.lit("</tr>"))).otherwise("")
    area = cell(F.lit("<b>Area\n"), F.col("l_partkey"), F.lit(" </b>"), F.when(F.col("l_returnflag") == "R", "*").otherwise(""))
    line = F.concat(county, F.lit('<tr class="d">'), area, cell(F.col("l_linestatus")), cell(F.col("l_returnflag")), F.lit("</tr>\n"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", line.alias("tr")))).alias("lines"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    html = F.concat(F.lit("<table><tr>"), cell(F.upper("o_orderpriority")), F.lit("</tr>"), F.array_join("lines.tr", ""), F.lit("</table>"))
    pages = lines.join(orders, "l_orderkey").select(F.col("l_orderkey").alias("page"), html.alias("html"))
    return records.page_rows(pages, "page", "html")


@registered("""WITH h AS (SELECT d.source AS county, l.quality, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id), p AS (SELECT county, CASE WHEN toxic = 1 THEN 'hostile' WHEN quality = 1 THEN 'by-right' ELSE 'special-exception' END AS posture, CASE WHEN quality = 1 THEN 'high' ELSE 'medium' END AS confidence FROM h)
SELECT posture, confidence, count(*)::BIGINT AS n, count(DISTINCT county)::BIGINT AS counties FROM p GROUP BY GROUPING SETS ((posture), (confidence), ())""")
def agg22_reconciliation_totals(spark, sf_dir):
    held = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("county")), "doc_id")
    held = held.select("county", F.when(F.col("toxic") == 1, "hostile").when(F.col("quality") == 1, "by-right").otherwise("special-exception").alias("posture"), F.when(F.col("quality") == 1, "high").otherwise("medium").alias("confidence"))
    sets = [[F.col("posture")], [F.col("confidence")], []]
    return held.groupingSets(sets, "posture", "confidence").agg(F.count("*").alias("n"), F.countDistinct("county").alias("counties"))


# ---- imagery: each two vectors in a row are a site before and after, an 8 x 8 tile


_PIXELS = """px AS (SELECT vec_id // 2 AS site_id, i - 1 AS pos, max(v) FILTER (WHERE half = 0)::DOUBLE AS b, max(v) FILTER (WHERE half = 1)::DOUBLE AS a
  FROM (SELECT vec_id, vec_id % 2 AS half, i, embedding[i] AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) GROUP BY 1, 2 HAVING count(*) = 2),
grid AS (SELECT site_id, pos // 8 AS r, pos % 8 AS c, abs(b) * 2 AS red_b, abs(a) * 2 AS red_a, abs(b) + 0.3::DOUBLE AS nir_b, abs(a) + 0.2::DOUBLE AS nir_a FROM px),
idx AS (SELECT site_id, CASE WHEN (r - 3.5) * (r - 3.5) + (c - 3.5) * (c - 3.5) <= 6 THEN 'aoi' WHEN (r - 3.5) * (r - 3.5) + (c - 3.5) * (c - 3.5) <= 18 THEN 'ring' END AS zone,
  (nir_b - red_b) / (nir_b + red_b) AS ndvi_b, (nir_a - red_a) / (nir_a + red_a) AS ndvi_a, red_b / 2 AS bright_b, red_a / 2 AS bright_a FROM grid),
dist AS (SELECT *, (ndvi_b - ndvi_a >= 0.15 OR bright_a - bright_b >= 0.03) AS disturbed, (bright_a >= 0.22 AND ndvi_a <= 0.15) AS built FROM idx WHERE zone IS NOT NULL)"""


@registered(f"""WITH {_PIXELS} SELECT site_id, zone, count(*)::BIGINT AS pixels, round(avg(ndvi_b) + 1e-7::DOUBLE, 4) AS ndvi_before, round(avg(ndvi_a) + 1e-7::DOUBLE, 4) AS ndvi_after, round(avg(disturbed::INT) + 1e-7::DOUBLE, 4) AS disturbed, round(avg(built::INT) + 1e-7::DOUBLE, 4) AS built FROM dist GROUP BY 1, 2""")
def agg14_zone_change(spark, sf_dir):
    z = raster.zone_change(raster.tiles(read(spark, sf_dir, "embeddings")))
    return z.select("site_id", "zone", "pixels", *[shown(c).alias(c) for c in ("ndvi_before", "ndvi_after", "disturbed", "built")])


@registered(f"""WITH {_PIXELS}, z AS (SELECT site_id, avg(disturbed::INT) FILTER (WHERE zone = 'aoi') - avg(disturbed::INT) FILTER (WHERE zone = 'ring') AS excess, avg(built::INT) FILTER (WHERE zone = 'aoi') AS built, count(*) AS n FROM dist GROUP BY 1)
SELECT site_id, round(excess + 1e-7::DOUBLE, 4) AS excess, CASE WHEN n < 50 THEN 'insufficient' WHEN excess >= 0.40 AND built >= 0.15 THEN 'structures_present' WHEN excess >= 0.15 THEN 'earthworks' WHEN excess >= 0.05 THEN 'possible' ELSE 'none' END AS verdict FROM z""")
def prj38_verdicts(spark, sf_dir):
    return raster.verdicts(raster.tiles(read(spark, sf_dir, "embeddings"))).withColumn("excess", shown("excess"))


@registered(f"""WITH {_PIXELS}, blocks AS (SELECT site_id, r // 2 AS block_row, c // 2 AS block_col, sum((( (nir_b - red_b) / (nir_b + red_b) - (nir_a - red_a) / (nir_a + red_a)) >= 0.15 OR red_a / 2 - red_b / 2 >= 0.03)::INT)::BIGINT AS disturbed FROM grid GROUP BY 1, 2, 3)
SELECT site_id, block_row, block_col, disturbed FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY disturbed DESC, block_row, block_col) AS place FROM blocks) WHERE place <= 3""")
def agg15_block_scan(spark, sf_dir):
    return raster.top_blocks(raster.tiles(read(spark, sf_dir, "embeddings")), 2, 3)


# ---- facts, records and accounting


@registered("""SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def src15_facts(spark, sf_dir):
    return records.facts(read(spark, sf_dir, "events"), "event_id", "props")


@registered("""WITH e AS (SELECT event_id, event_type, value, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(DATE '2024-01-01' + (event_id % 28)::INT AS VARCHAR) AS fetched_at FROM events)
SELECT event_id, 'k' AS key, CASE WHEN event_id % 10 <> 0 THEN k END AS value, NULL::VARCHAR AS said, 'count' AS unit, 'props' AS source, 0.5::DOUBLE AS confidence, fetched_at, 3600::BIGINT AS ttl_seconds, CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN k IS NULL THEN 'absent' ELSE 'present' END AS status FROM e
UNION ALL SELECT event_id, 'value', value, NULL, NULL, 'events', 1.0, fetched_at, NULL, CASE WHEN value IS NULL THEN 'absent' ELSE 'present' END FROM e
UNION ALL SELECT event_id, 'kind', NULL, event_type, NULL, 'events', NULL, NULL, NULL, CASE WHEN event_type IS NULL THEN 'absent' ELSE 'present' END FROM e""")
def src15_facts_in_full(spark, sf_dir):
    """Each event as a response with three fields: a count that fails for every tenth, a value, and a text."""
    k = F.when(F.col("event_id") % 10 != 0, F.get_json_object("props", "$.k"))
    at = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 28).cast("int")).cast("string")
    count = F.to_json(F.struct(
        k.alias("value"), F.lit("count").alias("unit"), F.lit("props").alias("source"), F.lit(0.5).alias("confidence"), at.alias("fetched_at"),
        F.lit(3600).alias("ttl_seconds"), F.when(F.col("event_id") % 10 == 0, "failed").alias("status"),
    ))
    value = F.to_json(F.struct(F.col("value").cast("string").alias("value"), F.lit("events").alias("source"), F.lit(1.0).alias("confidence"), at.alias("fetched_at")))
    kind = F.to_json(F.struct(F.col("event_type").alias("value"), F.lit("events").alias("source")))
    body = F.concat(F.lit('{"fields": {"k": '), count, F.lit(', "value": '), value, F.lit(', "kind": '), kind, F.lit("}}"))
    return records.facts_in_full(read(spark, sf_dir, "events").select("event_id", body.alias("body")), "event_id", "body")


@registered("""SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'view') AS view, max(value) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def agg20_facts_wide(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.max("value"))


@registered("""SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def win3_latest_record(spark, sf_dir):
    return records.latest(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@registered("""WITH u AS (SELECT user_id, event_id, value FROM events WHERE event_type <> 'view' UNION ALL SELECT user_id, event_id + 1000000000 AS event_id, value FROM events WHERE event_type = 'view')
SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM u GROUP BY 1""")
def snk4_response_upsert(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    stored, fresh = e.where("event_type <> 'view'").drop("event_type"), e.where("event_type = 'view'").drop("event_type").withColumn("event_id", F.col("event_id") + 1_000_000_000)
    return records.upserted(stored, fresh, ["user_id"], "event_id")


@registered("""WITH n AS (SELECT max(ts) AS now FROM events), ttl AS (SELECT * FROM (VALUES ('click', 1), ('view', 3), ('purchase', 7), ('signup', 30)) AS t(event_type, days))
SELECT e.event_type, count(*)::BIGINT AS fresh FROM events e JOIN ttl ON ttl.event_type = e.event_type, n WHERE e.ts > n.now - ttl.days * INTERVAL 1 DAY GROUP BY 1""")
def flt13_fresh_responses(spark, sf_dir):
    return records.fresh(read(spark, sf_dir, "events"), "event_type", {"click": 1, "view": 3, "purchase": 7, "signup": 30}).groupBy("event_type").agg(F.count("*").alias("fresh"))


@registered("""SELECT coalesce(event_type, 'total') AS endpoint, count(*)::BIGINT AS calls, count(*) FILTER (WHERE value < 5)::BIGINT AS hits, round(sum(value) + 1e-7::DOUBLE, 2) AS credits, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events GROUP BY ROLLUP (event_type)""")
def agg17_spend(spark, sf_dir):
    got = read(spark, sf_dir, "events").rollup(F.col("event_type").alias("endpoint")).agg(F.count("*").alias("calls"), F.count_if(F.col("value") < 5).alias("hits"), shown(F.sum("value"), 2).alias("credits"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("oldest"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("newest"))
    return got.withColumn("endpoint", F.coalesce("endpoint", F.lit("total")))


@registered("""WITH c AS (SELECT conv_id, turn, len(text) // 100 + CASE role WHEN 'assistant' THEN 12 ELSE 1 END AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations)
SELECT conv_id, turn, cost::BIGINT AS cost, (cost - coalesce(lag(cost) OVER w, 0))::BIGINT AS delta, sum(cost) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY i)""")
def win11_running_meter(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    cost = F.expr("char_length(text) div 100") + F.when(F.col("role") == "assistant", 12).otherwise(1)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = c.withColumn("cost", cost.cast("long"))
    return c.select("conv_id", "turn", "cost", (F.col("cost") - F.coalesce(F.lag("cost").over(order), F.lit(0))).alias("delta"), F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("spent"))


@registered("""SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS key FROM events""")
def scl_j1_canonical_key(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("key"))


@registered("""SELECT o_orderkey AS project, (CASE WHEN o_orderkey % 4 = 0 THEN make_date(y, 1, 1) WHEN o_orderkey % 4 = 1 THEN make_date(y, (q - 1) * 3 + 1, 1) WHEN o_orderkey % 4 = 2 THEN make_date(y, m, 1) ELSE o_orderdate::DATE END)::DATE::VARCHAR AS day, ['year', 'quarter', 'month', 'day'][(o_orderkey % 4 + 1)::INT] AS how
FROM (SELECT *, year(o_orderdate)::BIGINT AS y, quarter(o_orderdate)::BIGINT AS q, month(o_orderdate)::BIGINT AS m FROM orders)""")
def scl_d2_announced_dates(spark, sf_dir):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    said = F.when(k == 0, F.year(d).cast("string")).when(k == 1, F.concat(F.lit("Q"), F.quarter(d), F.lit(" "), F.year(d))).when(k == 2, F.date_format(d, "yyyy-MM")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    day, how = records.announced(said)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project"), day.cast("string").alias("day"), how.alias("how"))


@registered("""WITH f AS (SELECT o_orderkey AS fact, o_custkey % 3 AS case_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS knowable, o_totalprice AS value FROM orders), c AS (SELECT * FROM (VALUES (0, DATE '1997-03-01'), (1, DATE '1999-02-01'), (2, DATE '2000-09-01')) AS t(case_id, cutoff))
SELECT f.case_id, count(*)::BIGINT AS known, round(arg_max(value, knowable - DATE '1990-01-01' + fact / 1e9) + 1e-7::DOUBLE, 2) AS latest FROM f JOIN c ON f.case_id = c.case_id WHERE knowable <= cutoff GROUP BY 1""")
def flt12_point_in_time(spark, sf_dir):
    k = F.col("o_orderkey")
    facts = read(spark, sf_dir, "orders").select(k.alias("fact"), (F.col("o_custkey") % 3).alias("case_id"), F.when(k % 7 != 0, F.to_date("o_orderdate")).alias("knowable"), F.col("o_totalprice").alias("value"))
    known = records.knowable(facts, {0: "1997-03-01", 1: "1999-02-01", 2: "2000-09-01"})
    return known.groupBy("case_id").agg(F.count("*").alias("known"), shown(F.max_by("value", F.struct("knowable", "fact")), 2).alias("latest"))


@registered("""WITH a AS (SELECT c_custkey AS site, c_acctbal / 100 AS lat, -(c_custkey % 180)::DOUBLE AS lng FROM customer)
SELECT CASE WHEN lat BETWEEN 17 AND 72 AND lng BETWEEN -180 AND -64 THEN 'ok' WHEN lng BETWEEN 17 AND 72 AND lat BETWEEN -180 AND -64 THEN 'swapped' ELSE 'outside' END AS state, count(*)::BIGINT AS n FROM a GROUP BY 1""")
def flt3_envelope(spark, sf_dir):
    at = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), (F.col("c_acctbal") / 100).alias("lat"), (-(F.col("c_custkey") % 180)).cast("double").alias("lng"))
    return at.groupBy(records.envelope("lat", "lng").alias("state")).agg(F.count("*").alias("n"))


@registered("""SELECT c_custkey AS done FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def join12_not_yet_scored(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("done"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("done")).join(orders, "done", "left_anti")


@registered("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def join13_wanted_only(spark, sf_dir):
    wanted = read(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(wanted, "o_custkey", "left_semi")


@registered("""SELECT * FROM (SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2""")
def set5_intersect_except(spark, sf_dir):
    a = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    b = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    c = read(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("k"))
    return a.intersect(b).subtract(c)


@registered("""WITH f AS (SELECT o_orderkey AS request, o_orderkey % 5 + 1 AS plain, o_custkey % 3 > 0 AS parcel, o_custkey % 4 AS calcs, o_orderkey % 2 AS addresses FROM orders)
SELECT request, (plain + CASE WHEN parcel THEN 300 ELSE 0 END + addresses + greatest(CASE WHEN calcs > 0 THEN 2 ELSE 0 END, 12 * calcs))::BIGINT AS credits FROM f""")
def prj43_request_cost(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fields = F.concat(F.slice(F.array(*[F.lit(f"f{i}") for i in range(5)]), 1, (k % 5 + 1).cast("int")), F.when(c % 3 > 0, F.array(F.lit("parcel_id"), F.lit("owner"))).otherwise(F.array().cast("array<string>")))
    asked = read(spark, sf_dir, "orders").select(k.alias("request"), fields.alias("fields"), (c % 4).alias("calcs"), (k % 2).alias("addresses"))
    return asked.select("request", records.request_cost(asked.fields, asked.calcs, asked.addresses).cast("long").alias("credits"))
