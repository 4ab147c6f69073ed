"""Feeds that arrive as text: delimited lines, JSON bodies, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gazetteer(lines: DataFrame) -> DataFrame:
    """fips, name, land from lines with tabs or pipes; short lines go, a blank area is 0, fips stays text."""
    parts = F.split("line", r"[\t|]")
    held = lines.select(parts.alias("p")).where((F.size("p") >= 3) & (F.trim(F.col("p")[0]) != ""))
    land = F.when(F.trim(F.col("p")[2]) == "", 0.0).otherwise(F.trim(F.col("p")[2]).try_cast("double"))
    return held.select(F.trim(F.col("p")[0]).alias("fips"), F.trim(F.col("p")[1]).alias("name"), land.alias("land")).where("land is not null")


def offers(rows: DataFrame, least_gpus: int, least_ram: float) -> DataFrame:
    """usd per GPU of each offer body; bodies that don't parse, free ones and ones below the class's least size go."""
    keys = [c for c in rows.columns if c != "body"]
    held = rows.select(*keys, F.from_json("body", "num_gpus double, dph_total double, gpu_ram double").alias("o"))
    held = held.where((F.col("o.num_gpus") >= least_gpus) & (F.col("o.dph_total") > 0) & (F.col("o.gpu_ram") >= least_ram))
    return held.select(*keys, (F.col("o.dph_total") / F.col("o.num_gpus")).alias("usd"))


def json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed JSON lines; malformed ones are left out."""
    first = schema.split()[0]
    bad = "_malformed"
    held = lines.select(F.from_json("line", f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r")).select("r.*")
    return held.where(F.col(bad).isNull() & F.col(first).isNotNull()).drop(bad)


def series(rows: DataFrame, key: str) -> DataFrame:
    """key, day, n of the first series in a timeline body."""
    held = rows.select(key, F.from_json("body", "timeline array<struct<data: array<struct<date: string, value: long>>>>").alias("b"))
    points = held.select(key, F.inline(F.get("b.timeline", F.lit(0))["data"]))
    return points.select(key, F.to_date(F.substring("date", 1, 8), "yyyyMMdd").cast("string").alias("day"), F.col("value").alias("n"))


def rss_items(rows: DataFrame) -> DataFrame:
    """page_id, title, publication (the link's host) of each item of a news feed."""
    held = rows.select("page_id", F.from_xml("item", "title string, link string").alias("i"))
    return held.select("page_id", F.col("i.title").alias("title"), F.regexp_extract("i.link", "://([^/?#]*)", 1).alias("publication"))


def embedded_prices(rows: DataFrame) -> DataFrame:
    """page, gpu_class, usd from the price map inside a page's script; 0 means that nothing was traded."""
    body = F.regexp_extract("body", r'"pricesByHardwareType":(\{[^}]*\})', 1)
    held = rows.select("page", F.explode(F.from_json(body, "map<string, double>")).alias("gpu_class", "usd")).where("usd > 0")
    return held.select("page", F.col("gpu_class").cast("long").alias("gpu_class"), "usd")


def rate_rows(rows: DataFrame) -> DataFrame:
    """page, label, low, high of each row of a price table: the first cell is the label, the others are prices."""
    lines = rows.select("page", F.explode(F.regexp_extract_all("body", F.lit("<tr>(.*?)</tr>"), 1)).alias("row"))
    cells = lines.select("page", F.transform(F.regexp_extract_all("row", F.lit("<td>(.*?)</td>"), 1), lambda c: F.regexp_replace(c, "<[^>]+>", "")).alias("c"))
    prices = F.transform(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), lambda c: F.regexp_extract(c, r"\$([0-9.]+)", 1).try_cast("double"))
    return cells.select("page", F.col("c")[0].alias("label"), F.array_min(prices).alias("low"), F.array_max(prices).alias("high"))


def validated_posture(rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """record and verdict of each posture body: an unknown posture, a FIPS that stands twice, or ok."""
    held = rows.select(F.from_json("body", "record long, fips string, posture string").alias("r")).select("r.*")
    twice = held.groupBy("fips").agg(F.count("*").alias("n"))
    verdict = F.when(~F.col("posture").isin(*allowed), "posture").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return held.join(twice, "fips").select("record", verdict.alias("verdict"))


def dockets(rows: DataFrame, base: str) -> DataFrame:
    """page_id, snippet, url: the first snippet that isn't blank, else the cause, in 400 characters; absolute urls."""
    held = rows.select("page_id", F.from_json("body", "recap_documents array<struct<snippet: string>>, cause string, docket_absolute_url string").alias("d"))
    said = F.filter(F.transform("d.recap_documents", lambda x: F.trim(x["snippet"])), lambda s: s != "")
    snippet = F.coalesce(F.get(said, F.lit(0)), F.col("d.cause"))
    return held.select("page_id", F.substring(F.trim(F.regexp_replace(snippet, r"\s+", " ")), 1, 400).alias("snippet"), F.concat(F.lit(base), F.col("d.docket_absolute_url")).alias("url"))


def articles(rows: DataFrame, county: str) -> DataFrame:
    """id, seen, county_named of each listed article with a url and a title."""
    held = rows.select("id", F.from_json("body", "articles array<struct<url: string, title: string, seendate: string>>").alias("b"))
    flat = held.select("id", F.inline("b.articles")).where("url is not null and title is not null")
    return flat.select("id", F.to_date(F.substring("seendate", 1, 8), "yyyyMMdd").cast("string").alias("seen"), F.lower("title").contains(county).alias("county_named"))


def rate_cards(rows: DataFrame) -> DataFrame:
    """type, low, high over the positive prices of each listed type."""
    held = rows.select(F.inline(F.from_json("body", "types array<struct<displayName: long, securePrice: double, communityPrice: double>>")["types"]))
    real = lambda c: F.when(F.col(c) > 0, F.col(c))
    return held.select(F.col("displayName").alias("type"), F.least(real("securePrice"), real("communityPrice")).alias("low"), F.greatest(real("securePrice"), real("communityPrice")).alias("high"))


def scenes(rows: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """scene, cloud, epsg of each catalogue item that has a projection and all needed assets."""
    held = rows.select(F.from_json("body", "id long, properties struct<cloud: double, epsg: int>, assets map<string, string>").alias("i"))
    for asset in needed:
        held = held.where(F.map_contains_key("i.assets", asset))
    return held.where("i.properties.epsg is not null").select(F.col("i.id").alias("scene"), F.col("i.properties.cloud").alias("cloud"), F.col("i.properties.epsg").alias("epsg"))
