"""Registered streaming jobs, run over what the input has now and compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgate.plans.base import registered
from airgate.sources.derived import read
from airgate.streaming import jobs, marks, upserts


@registered("""SELECT ts::DATE::VARCHAR AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def str1_daily_volume(spark, sf_dir):
    found = jobs.drained(jobs.daily_volume(jobs.stream(spark, sf_dir, "events")), "complete")
    return found.select(F.to_date("start").cast("string").alias("day"), "event_type", "n")


@registered("""SELECT ts::DATE::VARCHAR AS day, (user_id % 6)::INT AS gpu_class, count(*)::BIGINT AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2""")
def str3_daily_marks(spark, sf_dir):
    found = jobs.drained(jobs.daily_marks(jobs.stream(spark, sf_dir, "events")), "complete")
    return found.select(F.to_date("start").cast("string").alias("day"), "gpu_class", "n", "low", "high")


@registered()
def str2_first_sight(spark, sf_dir):
    return jobs.drained(jobs.first_sight(jobs.stream(spark, sf_dir, "events"), ["user_id", "event_type"], "14 days"), "append")


@registered("""WITH c AS (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS upto FROM events),
m AS (SELECT *, min(upto) FILTER (WHERE upto >= 500) OVER (PARTITION BY user_id) AS crossed FROM c)
SELECT user_id, event_id, CASE WHEN crossed IS NULL THEN upto ELSE least(upto, crossed) END AS spent, coalesce(upto > crossed, false) AS refused FROM m""")
def str4_metered(spark, sf_dir):
    return jobs.drained(jobs.metered(jobs.stream(spark, sf_dir, "events"), ceiling=500.0), "append")


@registered("""SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1""")
def str5_incremental_upsert(spark, sf_dir):
    return jobs.upserted_table(jobs.stream(spark, sf_dir, "events"), read(spark, sf_dir, "events").schema, "user_id", "event_id").select("user_id", "event_id", "value")


_COUNTY = "'County ' || (user_id % 40)::VARCHAR"


@registered(f"""WITH panes AS (SELECT {_COUNTY} AS county, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2),
passed AS (SELECT unnest(generate_series((SELECT min(day) FROM panes)::TIMESTAMP, (SELECT max(ts) FROM events) - INTERVAL 2 DAY, INTERVAL 1 DAY))::DATE AS day),
slid AS (SELECT p.county, d.day, sum(p.n)::BIGINT AS behind, coalesce(sum(p.n) FILTER (WHERE p.day = d.day), 0)::BIGINT AS n
  FROM panes p JOIN passed d ON p.day <= d.day AND p.day > d.day - 180 GROUP BY 1, 2)
SELECT county, day::VARCHAR AS day, n, behind FROM slid""")
def str1_trailing_volume(spark, sf_dir):
    rows = jobs.stream(spark, sf_dir, "events").withColumn("county", F.concat(F.lit("County "), (F.col("user_id") % 40).cast("string")))
    with marks.many_windows(spark):
        found = jobs.drained(marks.trailing_volume(rows, "county"), "append")
    return found.select("county", F.col("day").cast("string").alias("day"), "n", "behind")


@registered("""WITH ticks AS (SELECT event_id, ts, (user_id % 6)::INT AS gpu_class, CASE WHEN event_type IN ('click', 'view') THEN 'spot' ELSE 'list' END AS kind, 'vendor ' || user_id AS source, value AS usd FROM events)
SELECT gpu_class, kind, source, count(*)::BIGINT AS n, min(usd) AS low, max(usd) AS high, arg_max(usd, (ts, event_id)) AS usd, max(ts)::VARCHAR AS marked,
  epoch_ms(max(ts)) + 24 * 3600000 < (SELECT epoch_ms(max(ts)) - 3600000 FROM ticks) AS stale FROM ticks GROUP BY 1, 2, 3""")
def str3_latest_marks(spark, sf_dir):
    rows = jobs.stream(spark, sf_dir, "events").select(
        "event_id", "ts", (F.col("user_id") % 6).cast("int").alias("gpu_class"), F.when(F.col("event_type").isin("click", "view"), "spot").otherwise("list").alias("kind"),
        F.concat(F.lit("vendor "), F.col("user_id").cast("string")).alias("source"), F.col("value").alias("usd"),
    )
    with marks.keyed_state(spark):
        told = jobs.drained(marks.latest_marks(rows), "update")
    return marks.last_told(told).select("gpu_class", "kind", "source", "n", "low", "high", "usd", F.col("marked").cast("string").alias("marked"), "stale")


@registered("""SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1""")
def str5_touched_parts(spark, sf_dir):
    rows = jobs.stream(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return upserts.kept_up(rows, "user_id", "event_id").read()
