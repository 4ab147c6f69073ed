"""Facts, stored responses, dates and request costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields billed together as one parcel group, its price, and prices of driving distances.
PARCEL_FIELDS, PARCEL_CREDITS, DRIVING_CREDITS, FLOOR = ("parcel_id", "owner", "zoning", "land_use"), 300, 12, 2


def facts(rows: DataFrame, key: str, body: str) -> DataFrame:
    """Long facts (key of the row, key, value) from a JSON object of numbers; values that are none are left out."""
    held = rows.select(key, F.explode(F.from_json(body, "map<string, double>")).alias("key", "value"))
    return held.where("value is not null")


def facts_in_full(rows: DataFrame, key: str, body: str) -> DataFrame:
    """Long facts with their provenance from {"fields": {name: {value, unit, source, ...}}}; absent and failed ones stay.

    Numbers are in value, all else in said. A field without status is present if it has a value, absent otherwise.
    Bodies that are null or no such object give no rows.
    """
    field = "struct<value: string, unit: string, source: string, confidence: double, fetched_at: string, ttl_seconds: bigint, status: string>"
    held = rows.select(key, F.explode(F.from_json(body, f"fields map<string, {field}>")["fields"]).alias("key", "f"))
    number = F.col("f.value").try_cast("double")
    said = F.when(number.isNull(), F.col("f.value"))
    status = F.coalesce("f.status", F.when(F.col("f.value").isNull(), "absent").otherwise("present"))
    kept = ("unit", "source", "confidence", "fetched_at", "ttl_seconds")
    return held.select(key, "key", number.alias("value"), said.alias("said"), *[F.col(f"f.{c}").alias(c) for c in kept], status.alias("status"))


def page_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Designation rows of county pages: key, row (its place), state, county, area, whole, designation, status.

    Table rows of one cell are headers: a state if the cell is in capitals, else a county of that state. Rows of three
    cells or more are designations of the last headers; an area with an asterisk is a part of its county (whole false).
    Rows before the first header have neither; a new state has no county yet. Null pages and rows of two cells give none.
    """
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cells = F.transform(
        F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)),
        lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " ")),
    )
    rows = rows.select(key, "row", cells.alias("cells"), F.size(cells).alias("n")).where("n = 1 or n >= 3")
    title = F.col("cells")[0]
    is_state = (title == F.upper(title)) & title.rlike("[A-Z]")
    so_far = Window.partitionBy(key).orderBy("row")
    rows = rows.withColumn("state", F.last(F.when((F.col("n") == 1) & is_state, title), ignorenulls=True).over(so_far))
    header = F.when(F.col("n") == 1, F.struct(F.when(~is_state, title).alias("county")))
    rows = rows.withColumn("county", F.last(header, ignorenulls=True).over(so_far)["county"]).where("n >= 3")
    area = F.trim(F.replace(title, F.lit("*"), F.lit("")))
    return rows.select(
        key, "row", "state", "county", area.alias("area"), (~F.contains(title, F.lit("*"))).alias("whole"), F.col("cells")[1].alias("designation"), F.col("cells")[2].alias("status")
    )


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; an aggregate, so that a frequent key needs no sort of its rows."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def upserted(stored: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    return latest(stored.unionByName(fresh), keys, order)


def fresh(rows: DataFrame, kind: str, days: dict[str, int]) -> DataFrame:
    """Rows no older than their kind's days before the newest row; kinds without days are left out."""
    ttl = F.lit(None).cast("int")
    for name, n in days.items():
        ttl = F.when(F.col(kind) == name, n).otherwise(ttl)
    now = rows.agg(F.max("ts").alias("now"))
    aged = rows.withColumn("ttl", ttl).where("ttl is not null").crossJoin(F.broadcast(now))
    return aged.where(F.col("ts") > F.col("now") - F.make_dt_interval(F.col("ttl"))).drop("ttl", "now")


def announced(said: Column) -> tuple[Column, Column]:
    """The date that a text announces (its earliest day) and how it was read: day, month, quarter or year."""
    iso, month = F.regexp_extract(said, r"^(\d{4}-\d{2}-\d{2})$", 1), F.regexp_extract(said, r"^(\d{4}-\d{2})$", 1)
    quarter, of = F.regexp_extract(said, r"^Q([1-4]) (\d{4})$", 1), F.regexp_extract(said, r"^Q([1-4]) (\d{4})$", 2)
    year = F.regexp_extract(said, r"^(\d{4})$", 1)
    how = F.when(iso != "", "day").when(month != "", "month").when(quarter != "", "quarter").when(year != "", "year")
    date = F.when(iso != "", iso).when(month != "", F.concat(month, F.lit("-01")))
    date = date.when(quarter != "", F.concat(of, F.lit("-"), F.lpad((F.expr("1") * (quarter.try_cast("int") - 1) * 3 + 1).cast("string"), 2, "0"), F.lit("-01")))
    date = date.when(year != "", F.concat(year, F.lit("-01-01")))
    return date.try_cast("date"), how


def knowable(facts: DataFrame, cutoffs: dict[int, str]) -> DataFrame:
    """Facts that were public by their case's cutoff; facts that never were have no date and go."""
    cutoff = F.lit(None).cast("date")
    for case, day in cutoffs.items():
        cutoff = F.when(F.col("case_id") == case, F.lit(day).cast("date")).otherwise(cutoff)
    return facts.where(F.col("knowable") <= cutoff)


def envelope(lat: str, lng: str) -> Column:
    """ok inside the country's envelope, swapped if it would be with the coordinates exchanged, else outside."""
    inside = lambda a, b: F.col(a).between(17, 72) & F.col(b).between(-180, -64)
    return F.when(inside(lat, lng), "ok").when(inside(lng, lat), "swapped").otherwise("outside")


def request_cost(fields: Column, calcs: Column, addresses: Column) -> Column:
    """Credits of a request: plain fields, the parcel group once, addresses, and driving distances with a floor."""
    parcel = F.array(*[F.lit(p) for p in PARCEL_FIELDS])
    driving = F.when(calcs > 0, F.greatest(F.lit(FLOOR), DRIVING_CREDITS * calcs)).otherwise(0)
    return F.size(F.array_except(fields, parcel)) + F.when(F.arrays_overlap(fields, parcel), PARCEL_CREDITS).otherwise(0) + addresses + driving


def hinted(facts: DataFrame, hints: dict[str, str]) -> DataFrame:
    """site, target, value: for each target the first fact, in order, whose key contains the target's hint."""
    one = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(h).alias("hint")) for t, h in hints.items()])
    dim = facts.sparkSession.range(1, numPartitions=1).select(F.inline(one))
    held = facts.join(F.broadcast(dim), F.lower("key").contains(F.col("hint")))
    return held.groupBy("site", "target").agg(F.min_by("value", "ord").alias("value"))


def cacheable(status: Column) -> Column:
    """Success, or a client error that is neither about access nor worth a retry."""
    return status.between(200, 299) | (status.between(400, 499) & ~status.isin(401, 403, 408, 429))
