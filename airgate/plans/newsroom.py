"""Registered jobs on headlines made of orders, with the rule's own terms, datelines, mastheads and counties planted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgate.operators import headlines
from airgate.operators.news import NATIONAL
from airgate.plans.base import registered, shown
from airgate.sources.derived import read

_COUNTIES = ("Linn", "Loudoun", "Clay", "Prince George's", "Kent", "St. Louis", "Marshall", "Johnson")
_OPENINGS = ("Board", "Residents packed hearing as board", "Officials", "Firefighters watch as council", "Supervisors", "Neighbors sued while planning commission", "Asphalt crews wait;")
_VERBS = ("votes to pause", "rejected", "studies", "passes moratorium on", "discusses rezoning for", "will fight", "welcomes")
_HEADS = ("", "ASHBURN, Va. — ", "[Cedar Rapids, Iowa] - ")
_TAILS = ("", " - The Daily Item", " | Local News 9", " – two-year plan")
_SUMMARIES = ("", "A public hearing on the ordinance drew opposition.", "No comment.", "The zoning text amendment was denied after a petition.")
_HOSTS = ("www.reuters.com", "dailyitem.com", "www.localnews9.com", "yahoo.com")

_pick = lambda xs, by: f"[{', '.join("'" + x.replace("'", "''") + "'" for x in xs)}][(({by}) % {len(xs)} + 1)::INT]"
_ITEMS = f"""items AS (SELECT k AS item_id, county, {_pick(_HEADS, 'k // 7')} || {_pick(_OPENINGS, 'k // 3')} || ' ' || {_pick(_VERBS, 'k // 5')} || ' data centers in ' || CASE WHEN k % 4 = 0 THEN county || ' County' WHEN k % 9 = 0 THEN other || ' County'
    ELSE 'the region' END || ' &amp; beyond' || {_pick(_TAILS, 'k // 11')} AS headline, {_pick(_SUMMARIES, 'k // 2')} AS summary, 'https://' || {_pick(_HOSTS, 'k')} || '/story/' || (k % 100) AS url
  FROM (SELECT o_orderkey AS k, {_pick(_COUNTIES, 'o_custkey')} AS county, {_pick(_COUNTIES, 'o_custkey + 3')} AS other FROM orders))"""


def _items(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda xs, by: F.element_at(F.array(*[F.lit(x) for x in xs]), (by % len(xs) + 1).cast("int"))
    div = lambda n: F.expr(f"o_orderkey div {n}")
    county, other = pick(_COUNTIES, c), pick(_COUNTIES, c + 3)
    place = F.when(k % 4 == 0, F.concat(county, F.lit(" County"))).when(k % 9 == 0, F.concat(other, F.lit(" County"))).otherwise("the region")
    headline = F.concat(pick(_HEADS, div(7)), pick(_OPENINGS, div(3)), F.lit(" "), pick(_VERBS, div(5)), F.lit(" data centers in "), place, F.lit(" &amp; beyond"), pick(_TAILS, div(11)))
    url = F.concat(F.lit("https://"), pick(_HOSTS, k), F.lit("/story/"), (k % 100).cast("string"))
    return read(spark, sf_dir, "orders").select(k.alias("item_id"), county.alias("county"), headline.alias("headline"), pick(_SUMMARIES, div(2)).alias("summary"), url.alias("url"))


_STEM = "CASE " + " ".join(f"WHEN length(w) > {len(e) + 3} AND ends_with(w, '{e}') THEN left(w, length(w) - {len(e)}) || '{r}'" for e, r in headlines.ENDINGS) + " ELSE w END"
_NORMAL = (
    "trim(regexp_replace(lower(regexp_replace(regexp_replace(replace(headline, '&amp;', '&'), '" + headlines.DATELINE + "', ''), '" + headlines.MASTHEAD + "', '')), '[^a-z0-9]+', ' ', 'g'))"
)
_HELD = lambda terms: "list_filter([" + ", ".join(f"'{t}'" for t in terms) + "], lambda t: contains(said, t))"
_READ = f"""{_ITEMS}, told AS (SELECT *, lower(headline || ' ' || summary) AS said, {_NORMAL} AS normal, regexp_extract_all(headline, '{headlines.NAMED.replace("'", "''")}', 1) AS counties FROM items),
stemmed AS (SELECT item_id, string_agg(s, ' ' ORDER BY first_at) AS stems FROM (SELECT item_id, s, min(i) AS first_at FROM (
  SELECT item_id, i, {_STEM} AS s FROM (SELECT item_id, unnest(string_split(normal, ' ')) AS w, generate_subscripts(string_split(normal, ' '), 1) AS i FROM told) WHERE length(w) > 2 AND NOT list_contains([{', '.join(f"'{w}'" for w in headlines.STOP)}], w)) GROUP BY 1, 2) GROUP BY 1),
seen AS (SELECT *, {_HELD(headlines.ACTION)} AS action, {_HELD(headlines.OPPOSITION)} AS opposition, {_HELD(headlines.PROCEEDING)} AS proceeding,
  len(counties) > 0 AND len(list_filter(counties, lambda n: contains(lower(n), regexp_replace(regexp_replace(lower(county), 's+$', ''), '''$', '')))) = 0 AS other_county,
  contains(lower(headline), lower(county) || ' county') AS named, NOT list_contains([{', '.join(f"'{h}'" for h in NATIONAL)}], regexp_replace(regexp_extract(url, '://([^/]*)', 1), '^www\\.', '')) AS local FROM told)"""


@registered(f"""WITH {_READ} SELECT item_id, coalesce(stems, '') AS stems FROM told LEFT JOIN stemmed USING (item_id)""")
def scl_s4_headline_stems(spark, sf_dir):
    return _items(spark, sf_dir).select("item_id", F.array_join(headlines.stems(F.col("headline")), " ").alias("stems"))


@registered(f"""WITH {_READ} SELECT item_id, array_to_string(action, ';') AS action, array_to_string(opposition, ';') AS opposition, array_to_string(proceeding, ';') AS proceeding, other_county, named, local FROM seen""")
def scl_s6_term_hits(spark, sf_dir):
    read_ = headlines.read_items(_items(spark, sf_dir))
    return read_.select("item_id", *[F.array_join(c, ";").alias(c) for c in ("action", "opposition", "proceeding")], "other_county", "named", "local")


_ASKED = f"""asked AS (SELECT county, sum(o_orderkey % 3)::DOUBLE AS baseline, county NOT IN ('Kent', 'Johnson') AS fetched, county = 'Clay' AS partial
  FROM (SELECT o_orderkey, {_pick(_COUNTIES, 'o_custkey')} AS county FROM orders) GROUP BY 1 UNION ALL SELECT 'Nowhere', 12, true, false)"""


@registered(f"""WITH {_READ}, {_ASKED}, counts AS (SELECT county, count(*) AS stories, count(*) FILTER (WHERE local) AS local, count(*) FILTER (WHERE named) AS named, count(*) FILTER (WHERE len(action) > 0) AS action,
  count(*) FILTER (WHERE len(opposition) > 0) AS opposition, count(*) FILTER (WHERE len(proceeding) > 0) AS proceeding, count(*) FILTER (WHERE len(action) > 0 AND named) AS action_named FROM seen WHERE NOT other_county GROUP BY 1),
held AS (SELECT a.*, {', '.join(f"CASE WHEN fetched THEN coalesce({c}, 0) END::BIGINT AS {c}" for c in ('stories', 'local', 'named', 'action', 'opposition', 'proceeding', 'action_named'))} FROM asked a LEFT JOIN counts USING (county)),
judged AS (SELECT *, CASE WHEN NOT fetched THEN 'unknown' WHEN action >= 2 AND action_named >= 1 THEN 'formal' WHEN stories >= 3 AND opposition >= 2 THEN 'organised' WHEN stories >= 2 THEN 'interest' ELSE 'quiet' END AS posture FROM held)
SELECT county, stories, local, named, action, opposition, proceeding, posture, baseline < 30 AS thin_media, round(stories / baseline + 1e-7::DOUBLE, 4) AS coverage_share,
  CASE WHEN NOT fetched THEN 'none' WHEN partial OR (posture = 'quiet' AND baseline < 30) OR stories < 3 OR named < 1 THEN 'low' WHEN stories >= 5 AND named >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM judged""")
def agg11_county_signals(spark, sf_dir):
    items = _items(spark, sf_dir)
    asked = items.groupBy("county").agg(F.sum(F.col("item_id") % 3).cast("double").alias("baseline"))
    asked = asked.unionByName(spark.range(1, numPartitions=1).select(F.lit("Nowhere").alias("county"), F.lit(12.0).alias("baseline")))
    asked = asked.select("county", "baseline", (~F.col("county").isin("Kent", "Johnson")).alias("fetched"), (F.col("county") == "Clay").alias("partial"))
    found = headlines.signals(asked, headlines.read_items(items))
    return found.select("county", "stories", "local", "named", "action", "opposition", "proceeding", "posture", "thin_media", shown("coverage_share").alias("coverage_share"), "confidence")


_PUBLISHED = "CASE WHEN item_id % 13 <> 0 THEN DATE '2024-01-01' + (item_id * 7 % 400)::INT END"


@registered(f"""WITH RECURSIVE {_READ}, held AS (SELECT t.item_id, t.county, t.normal, {_PUBLISHED.replace('item_id', 't.item_id')} AS day, list_sort(string_split(s.stems, ' ')) AS words FROM told t LEFT JOIN stemmed s USING (item_id)),
classes AS (SELECT county, normal, min(item_id) AS class_id, any_value(words) AS words, list(DISTINCT day) AS days, bool_or(day IS NULL) AS undated FROM held GROUP BY 1, 2),
links AS (SELECT a.class_id AS a, b.class_id AS b FROM classes a JOIN classes b ON a.county = b.county AND a.class_id < b.class_id
  WHERE 10 * len(list_intersect(a.words, b.words)) >= 6 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))
  AND (a.undated OR b.undated OR len(list_filter(a.days, lambda x: len(list_filter(b.days, lambda y: abs(x - y) <= 14)) > 0)) > 0)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), degree AS (SELECT a AS class_id, count(*) AS links FROM ways GROUP BY 1),
reach AS (SELECT class_id, class_id AS root FROM classes UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.class_id WHERE r.root < w.b),
story AS (SELECT class_id, min(root) AS story FROM reach GROUP BY 1)
SELECT h.item_id, c.class_id, coalesce(d.links, 0)::BIGINT AS links, s.story FROM held h JOIN classes c ON h.county = c.county AND h.normal = c.normal LEFT JOIN degree d ON d.class_id = c.class_id JOIN story s ON s.class_id = c.class_id""")
def join15_headline_classes(spark, sf_dir):
    k = F.col("item_id")
    items = _items(spark, sf_dir).withColumn("published", F.when(k % 13 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k * 7 % 400).cast("int"))))
    return headlines.headline_stories(items)
