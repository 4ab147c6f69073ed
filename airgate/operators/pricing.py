"""Rate quotes and what a delay costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hours in a month, power usage effectiveness, node watts of the reference accelerator.
MONTH_HOURS, PUE, NODE_WATTS = 730.0, 1.3, 1275.0
#: Scenario, utilisation, USD per accelerator hour, power margin.
SCENARIOS = (("low", 0.60, 1.73, 1.08), ("likely", 0.80, 2.395, 1.0), ("high", 0.92, 3.07, 0.88))


def consolidate(quotes: DataFrame) -> DataFrame:
    """One quote a class and kind: median, least, greatest, how many, and their sources."""
    sources = F.array_join(F.array_sort(F.collect_set("source")), ",")
    return quotes.groupBy("gpu_class", "kind").agg(F.median("usd").alias("likely"), F.min("usd").alias("low"), F.max("usd").alias("high"), F.count("*").alias("n"), sources.alias("sources"))


def trend(quotes: DataFrame) -> DataFrame:
    """Marks of the first and the last traded day of each class, and the change between them."""
    days = quotes.groupBy("gpu_class", F.to_date("ts").alias("day")).agg(F.avg("usd").alias("mark"))
    ends = days.groupBy("gpu_class").agg(F.min_by("mark", "day").alias("first_mark"), F.max_by("mark", "day").alias("last_mark"), F.count("*").alias("days"))
    return ends.withColumn("change_pct", (F.col("last_mark") / F.col("first_mark") - 1) * 100)


def as_of(asked: DataFrame, rates: DataFrame) -> DataFrame:
    """asked (event_id, gpu_class, ts) with `usd`, the last rate of its class at or before it.

    A class's rates and questions meet in time order, day by day: the last rate of each earlier day is carried over, so a
    window holds one class's day and not a class's whole history.
    """
    both = rates.select("gpu_class", "ts", "event_id", "usd", F.lit(False).alias("asks")).unionByName(
        asked.select("gpu_class", "ts", "event_id", F.lit(None).cast("double").alias("usd"), F.lit(True).alias("asks"))
    )
    both = both.withColumn("day", F.to_date("ts"))
    closing = both.where(~F.col("asks")).groupBy("gpu_class", "day").agg(F.max_by("usd", F.struct("ts", "event_id")).alias("closing"))
    days = both.select("gpu_class", "day").distinct().join(closing, ["gpu_class", "day"], "left")
    before = Window.partitionBy("gpu_class").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("gpu_class", "day", F.last("closing", True).over(before).alias("carried"))
    upto = Window.partitionBy("gpu_class", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("today", F.last("usd", True).over(upto)).where("asks")
    return held.join(carried, ["gpu_class", "day"]).select("event_id", "gpu_class", "ts", F.coalesce("today", "carried").alias("usd"))


def delay_values(projects: DataFrame) -> DataFrame:
    """projects (mw of load and plant, months of delay) by scenario: accelerators that fit (whole ones), their value."""
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(u).alias("utilisation"), F.lit(r).alias("rate"), F.lit(m).alias("margin")) for n, u, r, m in SCENARIOS])
    held = projects.select("*", F.inline(rows))
    fit = F.floor(F.col("mw") / PUE * 1e6 / (NODE_WATTS * F.col("margin"))).cast("long")
    held = held.withColumn("accelerators", fit)
    month = F.col("accelerators") * MONTH_HOURS * F.col("utilisation") * F.col("rate")
    return held.withColumns({"month_usd": month, "usd": F.col("accelerators") * MONTH_HOURS * F.col("months") * F.col("utilisation") * F.col("rate")})


def assessed_delay(projects: DataFrame) -> DataFrame:
    """project_id, months_delayed, it_load, load_derived, sole_source, accelerators, usd (likely case) of assessed projects.

    projects: mw of the plant, slack in months against the announced date, it_load_mw where it is stated, grid_tied. Delay is
    negative slack; a load that isn't stated is what the plant can serve at PUE. Projects without slack have no price.
    """
    held = projects.where("slack is not null").select(
        "project_id", F.greatest(F.lit(0.0), -F.col("slack")).alias("months_delayed"), F.coalesce("it_load_mw", F.col("mw") / PUE).alias("it_load"),
        F.col("it_load_mw").isNull().alias("load_derived"), (~F.col("grid_tied")).alias("sole_source"),
    )
    utilisation, rate, margin = next(s[1:] for s in SCENARIOS if s[0] == "likely")
    held = held.withColumn("accelerators", F.floor(F.col("it_load") * 1e6 / NODE_WATTS / margin).cast("long"))
    return held.withColumn("usd", F.col("accelerators") * MONTH_HOURS * F.col("months_delayed") * utilisation * rate)
