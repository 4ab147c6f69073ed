"""Equipment variants, overrides, reasons and scene choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgate.functions.rules import CRITERIA, OVERLAYS, PATHWAYS, POLLUTANTS
from airgate.operators import emissions, pathway
from airgate.operators.emissions import has, largest_criteria
from airgate.operators.graph import written
from airgate.operators.pathway import DESIGNATED, source_threshold


def options(plants: DataFrame) -> DataFrame:
    """Each plant's other configurations, labelled and in order; only those that make sense for it."""
    gas, turbine = F.col("fuel") == "natural_gas", F.col("prime_mover").contains("turbine")
    none = F.array().cast("array<string>")

    def option(label: str, order: int, on: Column, mover=None, fuel=None, controls=None, units=None) -> Column:
        return F.when(
            on,
            F.struct(
                F.lit(label).alias("label"), F.lit(order).alias("ord"), (F.lit(mover) if mover else F.col("prime_mover")).alias("prime_mover"),
                (F.lit(fuel) if fuel else F.col("fuel")).alias("fuel"), (F.col("controls") if controls is None else controls).alias("controls"),
                (F.lit(units) if units else F.col("units")).alias("units"),
            ),
        )

    plus = lambda control: F.array_append("controls", F.lit(control))
    rows = F.array_compact(
        F.array(
            option("add_scr", 1, turbine & ~has("scr"), controls=plus("scr")),
            option("add_catalyst", 2, gas & ~has("oxidation_catalyst") & (F.col("prime_mover") != "fuel_cell"), controls=plus("oxidation_catalyst")),
            option("tier4", 3, (F.col("prime_mover") == "diesel_recip") & ~has("tier4_final"), controls=plus("tier4_final")),
            option("combined_cycle", 4, (F.col("prime_mover") == "simple_cycle_turbine") & gas, mover="combined_cycle_turbine"),
            option("fuel_cell", 5, F.col("prime_mover") != "fuel_cell", mover="fuel_cell", fuel="natural_gas", controls=none),
            option("split", 6, F.col("units") == 1, units=2),
        )
    )
    held = plants.withColumn("o", F.explode(rows))
    rate = F.when(~F.col("o.ord").isin(4, 5), F.col("heat_rate"))
    return held.withColumns({c: F.col(f"o.{c}") for c in ("label", "ord", "prime_mover", "fuel", "controls", "units")} | {"heat_rate": rate}).drop("o")


#: The labels of `options` by ord, from 1.
LABELS = ("add_scr", "add_catalyst", "tier4", "combined_cycle", "fuel_cell", "split")


def first_option(decided: DataFrame, *plant: str) -> DataFrame:
    """plant and label of each plant's first decided option: no hard stop first, then rank, months and ord.

    The order is one whole number (months in millionths, then three bits each for rank and ord), so that a plant's options
    are aggregated by hash where they are made, and one row a plant travels.
    """
    micro = F.round(F.round("months_likely", 6) * 1e6).cast("long")
    order = (((F.when(F.col("n_stops") > 0, 8).otherwise(0) + F.col("rank")).cast("long") * (1 << 50) + micro * 8) + F.col("ord")).cast("long")
    best = decided.groupBy(*plant).agg(F.min(order).alias("o"))
    return best.select(*plant, F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("o") % 8).cast("int")).alias("label"))


#: The options of `weighed` in the order that breaks ties.
OPTIONS = (
    "add_scr", "add_catalyst", "add_both", "dry_low_nox", "combined_cycle", "combined_cycle_both", "tier4", "fuel_cell", "hour_cap", "hour_cap_both", "split",
)


#: What options change of a design.
CHANGED = ("prime_mover", "fuel", "controls", "units")


def changed_designs(divisible: Column) -> list[Column]:
    """Of each of OPTIONS struct(label, ord, *CHANGED), the design with it; null where it doesn't make sense.

    divisible says whether the plant is one that may be split.
    """
    mover, turbine = F.col("prime_mover"), F.col("prime_mover").contains("turbine")
    scr, catalyst, simple = has("scr"), has("oxidation_catalyst"), F.col("prime_mover") == "simple_cycle_turbine"
    plus = lambda control: F.array_append("controls", F.lit(control))
    both = F.concat("controls", F.array_except(F.array(F.lit("scr"), F.lit("oxidation_catalyst")), F.col("controls")))
    combined, none = F.lit("combined_cycle_turbine"), F.array().cast("array<string>")
    changes = {
        "add_scr": (~scr, {"controls": plus("scr")}),
        "add_catalyst": (~catalyst, {"controls": plus("oxidation_catalyst")}),
        "add_both": (~scr & ~catalyst, {"controls": both}),
        "dry_low_nox": (turbine & ~has("dry_low_nox"), {"controls": plus("dry_low_nox")}),
        "combined_cycle": (simple, {"prime_mover": combined}),
        "combined_cycle_both": (simple & ~(scr & catalyst), {"prime_mover": combined, "controls": both}),
        "tier4": ((mover == "diesel_recip") & ~has("tier4_final"), {"controls": plus("tier4_final")}),
        "fuel_cell": (mover != "fuel_cell", {"prime_mover": F.lit("fuel_cell"), "fuel": F.lit("natural_gas"), "controls": none}),
        "hour_cap": (F.lit(True), {}),
        "hour_cap_both": (~(scr & catalyst), {"controls": both}),
        "split": (divisible, {"units": F.lit(2)}),
    }
    return [
        F.when(on, F.struct(F.lit(label).alias("label"), F.lit(k).alias("ord"), *[held.get(c, F.col(c)).alias(c) for c in CHANGED]))
        for k, (label, (on, held)) in enumerate((label, changes[label]) for label in OPTIONS)
    ]


def weighed(decided: DataFrame) -> DataFrame:
    """Every option of a plant that was decided at its site, decided there in its turn: a row an option.

    Adds label, ord (its place in OPTIONS), base_rank, base_months, rank_delta and months_saved (more is better) and
    availability (the share of the year that an enforceable limit leaves). An option that equals the plant or an earlier
    option, breaks a rule or has no emission factors has no row. A stated heat rate stays. An hour cap is for plants over
    the least threshold at their site and leaves at least 1,000 hours; splitting is for one-unit major sources. Sites
    aren't joined again, so options add no shuffle.
    """
    rows = changed_designs((F.col("units") == 1) & (F.col("rank") >= 3))
    base = decided.withColumns({"base_rank": F.col("rank"), "base_months": F.col("months_likely"), "cap_threshold": pathway.synthetic_cap()["cap_threshold"]})
    d = base.withColumn("o", F.explode(F.array_compact(F.array(*rows))))
    d = d.withColumns({c: F.col(f"o.{c}") for c in ("label", "ord", *CHANGED)}).drop("o", "rejected", "heat_input", "effective_hours", *(f"{p}_tpy" for p in POLLUTANTS))
    d = emissions.estimate(d)
    capped, worst = F.col("label").isin("hour_cap", "hour_cap_both"), largest_criteria()["tpy"]
    hours = 8760 * F.col("cap_threshold") * 0.9 / (worst * 8760 / F.col("effective_hours"))
    # Generated, not projected: a projection would be inlined into each of the columns and filters that use it.
    held = F.struct(F.when(capped, hours).alias("cap_hours"), worst.alias("uncapped"))
    d = d.select("*", F.inline(F.array(held))).where(~capped | ((F.col("uncapped") >= F.col("cap_threshold")) & (F.col("cap_hours") >= 1000)))
    share = F.when(capped, F.col("cap_hours") / F.col("effective_hours")).otherwise(1.0)
    d = d.withColumns({f"{p}_tpy": F.col(f"{p}_tpy") * share for p in POLLUTANTS})
    d = d.withColumns({"run_hours": F.coalesce("cap_hours", "run_hours"), "effective_hours": F.coalesce("cap_hours", "effective_hours"), "enforceable": capped | F.col("enforceable")})
    d = pathway.decide(d)
    return d.withColumns(
        {
            "rank_delta": F.col("base_rank") - F.col("rank"), "months_saved": F.col("base_months") - F.col("months_likely"),
            "availability": F.when(F.col("enforceable"), F.col("run_hours") / 8760).otherwise(1.0),
        }
    )


def weighed_in_brief(plants: DataFrame) -> DataFrame:
    """The rows of `weighed`, with what there is to compare: no triggers, names of stops, ranges of months or offsets.

    plants have the `site` (of `pathway.in_brief`) that they are planned for and site_cap, the least threshold of its
    designations; they need not be decided before. Movers, fuels and controls are few, so the options of each are worked out
    once and kept as a small table: a plant meets its own by number, and pays for products and comparisons only.
    """
    key = ["prime_mover", "fuel", "controls"]
    seen = plants.select(*key).distinct().withColumns({"design": F.monotonically_increasing_id(), "units": F.lit(1)})
    own = F.struct(F.lit(None).cast("string").alias("label"), F.lit(-1).alias("ord"), *CHANGED)
    rows = written(seen).select(F.struct(*key).alias("own"), "design", F.explode(F.array_compact(F.array(own, *changed_designs(F.lit(True))))).alias("o"))
    table = written(emissions.rated(rows.select("own", "design", "o.*").drop("units")))
    d = plants.join(table.where("ord = -1").select("own.*", "design", *[c for c in table.columns if c not in ("own", "design", "label", "ord", *key)]), key)
    d = pathway.decide_in_brief(emissions.at_rates(d))
    told = {"base_rank": F.col("rank"), "base_months": F.col("months_likely"), "cap_threshold": F.least(pathway.source_threshold(), "site_cap")}
    d = d.withColumns(told).drop("rank", "months_likely", "n_stops", "site_cap", "heat_input", "effective_hours", *key, *(f"{p}_tpy" for p in CRITERIA))
    capped, split = (F.col("ord").isin(*[OPTIONS.index(x) for x in of]) for of in (("hour_cap", "hour_cap_both"), ("split",)))
    d = d.join(table.where("ord >= 0").drop("own"), "design").where(~split | ((F.col("units") == 1) & (F.col("base_rank") >= 3)))
    # array_compact for the reason that `decide_in_brief` gives, and for the few rows that are capped.
    worst = F.when(capped, F.array_max(F.array_compact(F.array(*[f"{p}_tpy" for p in CRITERIA]))))
    d = emissions.at_rates(d).withColumns({"units": F.when(split, 2).otherwise(F.col("units")), "uncapped": worst})
    d = d.withColumn("cap_hours", F.when(F.col("uncapped") >= F.col("cap_threshold"), 8760 * F.col("cap_threshold") * 0.9 / (F.col("uncapped") * 8760 / F.col("effective_hours"))))
    d = d.where(~capped | (F.col("cap_hours") >= 1000))
    share = F.when(capped, F.col("cap_hours") / F.col("effective_hours")).otherwise(1.0)
    d = d.withColumns({f"{p}_tpy": F.col(f"{p}_tpy") * share for p in CRITERIA} | {"run_hours": F.coalesce("cap_hours", "run_hours"), "enforceable": capped | F.col("enforceable")})
    d = pathway.decide_in_brief(d.drop("design", "uncapped", "cap_hours", "effective_hours"))
    return d.withColumns(
        {
            "pathway": F.element_at(F.array(*[F.lit(p[0]) for p in PATHWAYS]), F.col("rank") + 1),
            "rank_delta": F.col("base_rank") - F.col("rank"), "months_saved": F.col("base_months") - F.col("months_likely"),
            "availability": F.when(F.col("enforceable"), F.col("run_hours") / 8760).otherwise(1.0),
        }
    )


def best_option(options: DataFrame, *plant: str) -> DataFrame:
    """Of each plant's `weighed` options, in full or in brief, the first that improves its pathway or saves over a month; plants without one have no row.

    The order is: no hard stop first, then the better pathway, the months saved, the availability and OPTIONS.
    """
    better = (F.col("rank_delta") > 0) | (F.round("months_saved", 6) > 1)
    n_stops = F.col("n_stops") if "n_stops" in options.columns else F.size("stops")
    stopped, saved, available = (n_stops > 0).cast("int"), F.round("months_saved", 6), F.round("availability", 9)
    order = F.when(better, F.struct(stopped, -F.col("rank_delta"), -saved, -available, "ord", "mw", "controls"))
    kept = F.struct("label", "pathway", "rank", "rank_delta", "months_likely", "months_saved", "availability", "run_hours")
    return options.groupBy(*plant).agg(F.min_by(kept, order).alias("o")).where("o is not null").select(*plant, "o.*")


def overridden(plants: DataFrame) -> DataFrame:
    """plants with their `change` (prime_mover, run_hours, enforceable; null keeps) applied.

    A new mover brings its fuel, and controls that don't apply to it go.
    """
    mover = F.coalesce("change.prime_mover", "prime_mover")
    fuel = F.when(F.col("change.prime_mover").isNull(), F.col("fuel")).when(mover == "diesel_recip", "diesel").otherwise("natural_gas")
    turbine, cell = mover.contains("turbine"), mover == "fuel_cell"
    fits = F.filter(
        "controls",
        lambda c: (c != "none") & ~cell & (turbine | ~c.isin("dry_low_nox", "water_injection")) & ((mover == "diesel_recip") | (c != "tier4_final")),
    )
    controls = F.when(F.col("change.prime_mover").isNull(), F.col("controls")).otherwise(fits)
    held = {"prime_mover": mover, "fuel": fuel, "controls": controls, "run_hours": F.coalesce("change.run_hours", "run_hours"), "enforceable": F.coalesce("change.enforceable", "enforceable")}
    return plants.withColumns(held).drop("change")


def caveats() -> Column:
    """Codes of what a decision didn't know."""
    unlisted = F.coalesce(*[F.col(f"{p}_class") for p in DESIGNATED]).isNull()
    return F.array_compact(
        F.array(
            F.when(~F.col("state").isin(*OVERLAYS), "unmodelled_state"), F.when(unlisted, "no_designation"),
            F.when(F.col("class_i_km").isNull(), "no_class_i"), F.when(F.col("gas_pipeline_km").isNull(), "gas_unread"),
        )
    )


def facts_to_buy(share: float = 0.6) -> Column:
    """The physical facts worth reading: those of a major source only where the plant comes near the threshold."""
    shaped = largest_criteria()["tpy"] >= share * source_threshold()
    return F.array_compact(
        F.array(
            F.when(shaped, "terrain"), F.when(shaped, "class_i"), F.when(F.col("fuel") == "natural_gas", "gas"), F.when(shaped & (F.col("residents_1km") > 0), "residents")
        )
    )


def proximity_targets(share: float = 0.6) -> Column:
    """An array of struct(target, chosen, reason, asked): the nearest features to read, and for those not worth it why.

    Targets that don't bear on the plant at all are not asked for.
    """
    shaped = (largest_criteria()["tpy"] >= share * source_threshold()) | (F.col("prime_mover") == "diesel_recip")
    gas, grid, tall = F.col("fuel") == "natural_gas", F.col("grid_tied") | (F.col("mw") > 100), F.col("prime_mover").contains("turbine")
    rows = [("gas_pipeline", gas, None), ("transmission", grid, None), ("substation", grid, None), ("airport", tall, "short_stack"), ("urban_area", shaped, "no_modelling"), ("school", shaped, "no_modelling")]
    asked = lambda on, why: on if why is None else F.lit(True)
    return F.array(*[F.struct(F.lit(n).alias("target"), on.alias("chosen"), F.when(~on, F.lit(why)).alias("reason"), asked(on, why).alias("asked")) for n, on, why in rows])


def scene_pick(scenes: DataFrame, days: int = 9, bucket: int = 259_200, clouds: float = 60.0, probes: int = 10, clean: float = 2.0) -> DataFrame:
    """One scene a site near its target: the first clean one of the first probes (by distance in time, then cloud), else the clearest."""
    targets = scenes.groupBy(F.col("user_id").alias("site")).agg((F.min("ts") + F.expr("INTERVAL 10 DAY")).alias("target"))
    held = scenes.select("event_id", F.col("user_id").alias("site"), "ts", F.col("value").alias("cloud")).where(F.col("cloud") < clouds).join(targets, "site")
    held = held.where((F.col("ts") >= F.col("target") - F.expr(f"INTERVAL {days} DAY")) & (F.col("ts") <= F.col("target") + F.expr(f"INTERVAL {days} DAY")))
    early, late = F.least("ts", "target"), F.greatest("ts", "target")
    away = F.floor((F.unix_seconds(F.date_trunc("second", late).cast("timestamp")) - F.unix_seconds(F.date_trunc("second", early).cast("timestamp"))) / bucket)
    place = F.row_number().over(Window.partitionBy("site").orderBy(away, F.round("cloud"), "event_id"))
    held = held.withColumn("place", place).where(F.col("place") <= probes)
    worth = F.when(F.col("cloud") <= clean, F.col("place").cast("double")).otherwise(1000 + F.col("cloud") * 1000 + F.col("place"))
    return held.groupBy("site").agg(F.min_by("event_id", worth).alias("scene"))
