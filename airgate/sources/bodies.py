"""Nested bodies: values embedded in pages, JSON of any shape, lookups flattened to facts, batches aligned by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a jurisdiction lookup that are facts of their own, and the one that has a unit.
LOOKUP_KEYS = (
    "county_fips county state state_fips tract_geoid block_group_geoid block_geoid congressional_district cbsa_name cbsa_code fema_flood_zone "
    "within_floodplain coastal_high_hazard in_opportunity_zone opportunity_zone_tract_geoid timezone elevation_m"
).split()
#: What of a parcel is no fact.
PARCEL_BLOBS = ("geometry", "geometry_wkt")


# ---- a balanced object inside a page


def unescaped(body: Column) -> Column:
    """Quotes and backslashes of a string literal as themselves."""
    return F.replace(F.replace(body, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def balanced(text: Column) -> Column:
    """The shortest beginning of text, which starts with `{`, in which as many braces open as close; null without one.

    Only braces are looked at: their positions are where the text is split, and the first place at which the count is back
    to zero is where the object ends. Text between them is never walked by the character.
    """
    closed = F.split(text, r"\}")
    # Piece i ends in a closing brace; after it the depth is the number of opening ones so far, less i + 1.
    opens = F.transform(closed, lambda piece: F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit(""))))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("last"))
    last = F.aggregate(
        F.slice(opens, F.lit(1), F.greatest(F.size(closed) - 1, F.lit(0))),
        start,
        lambda s, n: F.struct(
            (s["depth"] + n - 1).alias("depth"), (s["seen"] + 1).alias("seen"), F.coalesce(s["last"], F.when(s["depth"] + n - 1 == 0, s["seen"] + 1)).alias("last")
        ),
        lambda s: s["last"],
    )
    return F.concat(F.call_function("substring_index", text, F.lit("}"), last), F.lit("}"))


def index_points(pages: DataFrame, key: str = "pricesByHardwareType") -> DataFrame:
    """page, hardware, pos, day, avg, low, high of each point of each series embedded in a page, in feed order, latest first.

    The object stands in a script behind its key, its quotes escaped. avg = 0 means that nothing was traded, so traded says
    whether the point is a price. Dates lose the marker before them; low and high fall back to avg. Pages without the key,
    with an object that never ends or that is no JSON have no points.
    """
    text = unescaped(F.col("body"))
    rest = F.regexp_extract(text, f'(?s)"{key}"\\s*:\\s*(\\{{.*)', 1)
    # Generated, not projected: a projection would be inlined, and the page made and searched again, wherever it is used.
    held = pages.select("page", F.explode(F.array(F.nullif(rest, F.lit("")))).alias("rest")).where("rest is not null").select("page", balanced(F.col("rest")).alias("object"))
    point = "struct<date: string, avg: double, bottom: double, top: double>"
    series = held.select("page", F.explode(F.from_json("object", f"map<string, array<{point}>>")).alias("hardware", "series"))
    points = series.select("page", "hardware", F.posexplode("series").alias("pos", "p")).where("p is not null")
    avg = F.col("p.avg")
    some = lambda c: F.coalesce(F.when(F.col(c) != 0, F.col(c)), avg)
    day = F.substring(F.regexp_replace("p.date", r"^[$D]+", ""), 1, 10)
    return points.select("page", "hardware", "pos", day.alias("day"), avg.alias("avg"), some("p.bottom").alias("low"), some("p.top").alias("high"), F.coalesce(avg > 0, F.lit(False)).alias("traded"))


def index_quotes(points: DataFrame) -> DataFrame:
    """page, hardware, usd, low, high, day of the latest traded point, and n_traded, first_usd: how the traded ones began."""
    traded = points.where("traded")
    return traded.groupBy("page", "hardware").agg(
        F.min_by(F.struct(F.col("avg").alias("usd"), "low", "high", "day"), "pos").alias("q"), F.count("*").alias("n_traded"), F.max_by("avg", "pos").alias("first_usd")
    ).select("page", "hardware", "q.*", "n_traded", "first_usd")


# ---- JSON of any shape


def canonical_json(body: Column, places: int = 6) -> Column:
    """A JSON body with its keys in order at every depth, no spacing, and fractions rounded to `places`, halves to
    the even digit; null for other text.

    As a variant an object has its keys in order, at any depth, and arrays keep theirs. Of its text the numbers outside
    strings are rounded: those with a point or an exponent, written without trailing zeros, so that 1.0 is 1. Row by row,
    whatever the body's shape. Fractions beyond 22 digits before the point stay as they are.
    """
    text = F.to_json(F.try_parse_json(body))
    parts = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'), F.lit(0))
    rounded = lambda x: F.bround(x.try_cast("double"), places).try_cast(f"decimal(28,{places})").cast("string")
    short = lambda x: F.regexp_replace(F.regexp_replace(x, r"\.?0+$", ""), "^-0$", "0")
    fraction = lambda x: ~x.startswith('"') & x.rlike("^-?[0-9]+(\\.|[eE])")
    return F.array_join(F.transform(parts, lambda x: F.when(fraction(x), F.coalesce(short(rounded(x)), x)).otherwise(x)), "")


def response_key(endpoint: Column, body: Column) -> Column:
    """What a stored response is found by: sha256 of its endpoint and the canonical body."""
    return F.sha2(F.concat(endpoint, F.lit("\0"), canonical_json(body)).cast("binary"), 256)


# ---- lookups and batches


def lookup_facts(rows: DataFrame, key: str = "site_id") -> DataFrame:
    """key, fact, value, unit, source of a lookup body: 17 flat keys, county_market.<name> and parcel.<name>.

    Values are text, nested ones JSON. Flat and parcel keys without a value are no facts; market keys are, so that a market
    without a figure can be told from one that wasn't asked for. Of a parcel shapes are left out, its area is in m2, and its
    source is what it says itself. Where the parcel was unavailable the reason is a fact. A body that is no JSON has none.
    """
    maps = "map<string, string>"
    held = rows.select(key, F.from_json("body", maps).alias("b"))
    held = held.select(key, "b", F.from_json(F.col("b")["county_market"], maps).alias("market"), F.from_json(F.col("b")["parcel"], maps).alias("parcel"))
    fact = lambda name, value, unit, source: F.struct(name.alias("fact"), value.alias("value"), unit.alias("unit"), source.alias("source"))
    none, lookup = F.lit(None).cast("string"), F.lit("lookup")
    flat = F.array(*[fact(F.lit(k), F.col("b")[k], F.lit("meters") if k == "elevation_m" else none, lookup) for k in LOOKUP_KEYS])
    pairs = lambda c: F.coalesce(F.map_entries(c), F.map_entries(F.from_json(F.lit("{}"), maps)))
    market = F.transform(pairs("market"), lambda e: fact(F.concat(F.lit("county_market."), e["key"]), e["value"], none, F.lit("county_market")))
    listed = F.filter(pairs("parcel"), lambda e: ~e["key"].isin(*PARCEL_BLOBS) & e["value"].isNotNull())
    own = F.coalesce(F.col("parcel")["source"], F.lit("parcel"))
    parcel = F.transform(listed, lambda e: fact(F.concat(F.lit("parcel."), e["key"]), e["value"], F.when(e["key"] == "area_m2", "m2"), own))
    gone = F.when(F.coalesce(F.col("b")["parcel_unavailable"], F.lit("false")).isin("true", "1"), fact(F.lit("parcel.unavailable_reason"), F.col("b")["parcel_unavailable_reason"], none, lookup))
    stated = F.filter(flat, lambda f: f["value"].isNotNull())
    return held.select(key, F.inline(F.concat(stated, market, parcel, F.filter(F.array(gone), lambda f: f.isNotNull()))))


def batch_results(locations: DataFrame, bodies: DataFrame) -> DataFrame:
    """Every location (batch, place, ...) with status and fields of the entry of its batch's body that has its place as index.

    status is ok, failed (the entry says so; fields are null for that location alone) or missing (no entry). Of several
    entries with one index the last counts; entries whose index is no whole number or no location's are left out, as are
    bodies that are no JSON. fields is a map of JSON texts.
    """
    entry = "struct<index: string, ok: boolean, fields: map<string, string>>"
    held = bodies.select("batch", F.posexplode(F.from_json("body", f"results array<{entry}>")["results"]).alias("pos", "e"))
    held = held.select("batch", "pos", F.when(F.col("e.index").rlike("^[0-9]{1,9}$"), F.col("e.index").cast("int")).alias("place"), F.coalesce("e.ok", F.lit(False)).alias("ok"), "e.fields")
    last = held.where("place is not null").groupBy("batch", "place").agg(F.max_by(F.struct("ok", "fields"), "pos").alias("e"))
    both = locations.join(last, ["batch", "place"], "left")
    status = F.when(F.col("e").isNull(), "missing").when(F.col("e.ok"), "ok").otherwise("failed")
    return both.withColumns({"status": status, "fields": F.when(F.col("e.ok"), F.col("e.fields"))}).drop("e")
