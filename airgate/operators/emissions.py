"""Potential to emit of plant designs, one double column a pollutant so that whole-stage codegen covers the arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgate.functions.rules import CONTROL_EFFICIENCY, CRITERIA, EMISSION_FACTORS, GRAMS_PER_LB, HEAT_RATES, POLLUTANTS, SIGNIFICANT, TIER4
from airgate.operators.graph import written


def has(control: str) -> Column:
    return F.array_contains("controls", control)


def size_error() -> Column:
    """The first rule that a plant's size or hours break, whatever its design; null where they break none."""
    return F.when(F.col("mw") <= 0, "mw").when((F.col("run_hours") <= 0) | (F.col("run_hours") > 8760), "run_hours")


def design_error() -> Column:
    """The first rule that a mover, its fuel and its controls break; null for a coherent design."""
    turbine, mover, fuel = F.col("prime_mover").contains("turbine"), F.col("prime_mover"), F.col("fuel")
    return (
        F.when((fuel == "diesel") & mover.isin("recip_lean_burn", "recip_rich_burn", "fuel_cell"), "no_diesel")
        .when((fuel == "natural_gas") & (mover == "diesel_recip"), "needs_diesel")
        .when(has("tier4_final") & (mover != "diesel_recip"), "tier4_not_engine")
        .when((has("dry_low_nox") | has("water_injection")) & ~turbine, "turbine_only_control")
    )


def config_error() -> Column:
    """The first rule that a plant breaks; null for a coherent one."""
    return size_error().otherwise(design_error())


def factors(spark: SparkSession) -> DataFrame:
    """prime_mover, fuel, heat_rate_default and ef_<pollutant>: a few rows, fixed."""
    rows = [(*key, HEAT_RATES[key[0]], *ef) for key, ef in EMISSION_FACTORS.items()]
    names = ["prime_mover", "fuel", "heat_rate_default", *(f"ef_{p}" for p in POLLUTANTS)]
    one = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names, strict=True)]) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(one))


def _kept(pollutant: str) -> str:
    """SQL: what the control stack leaves: each control in turn, twice if listed twice, none if it doesn't bear on it."""
    left = ["1D"]
    for control, removes in CONTROL_EFFICIENCY.items():
        if pollutant in removes:
            left.append(f"power({1 - removes[pollutant]!r}D, size(controls) - size(array_remove(controls, '{control}')))")
    return " * ".join(left)


def estimate(plants: DataFrame, with_rejects: bool = False) -> DataFrame:
    """plants with heat_input, effective_hours and <pollutant>_tpy, all at the potential to emit.

    Hours below 8,760 count only where they are enforceable. A heat rate of 0 or null is the mover's default. Designs that
    break a rule or have no emission factors carry the reason in `rejected` and no emissions; they go unless asked for.
    """
    held = plants.join(F.broadcast(factors(plants.sparkSession)), ["prime_mover", "fuel"], "left")
    held = held.withColumns({
        "rejected": F.coalesce(config_error(), F.expr("if(ef_nox is null, 'no_factors', null)")), "effective_hours": F.expr("if(enforceable, run_hours, 8760D)"),
        "heat_input": F.expr("mw * 1000 * coalesce(nullif(heat_rate, 0D), heat_rate_default) / 1e6D"),
    })
    if not with_rejects:
        held = held.where("rejected is null")
    amounts = {}
    for p in POLLUTANTS:
        lb_hr = f"ef_{p} * ({_kept(p)}) * heat_input"
        if p in TIER4:
            lb_hr = f"if(array_contains(controls, 'tier4_final'), {TIER4[p]!r}D * mw * 1000 / {GRAMS_PER_LB!r}D, {lb_hr})"
        amounts[f"{p}_tpy"] = F.expr(f"if(rejected is null, {lb_hr} * effective_hours / 2000, null)")
    return held.withColumns(amounts).drop("heat_rate_default", *(f"ef_{p}" for p in POLLUTANTS))


def rated(designs: DataFrame, pollutants: tuple[str, ...] = CRITERIA) -> DataFrame:
    """Coherent designs (prime_mover, fuel, controls) that have emission factors, with heat_rate_default, <pollutant>_lb
    (what the controls leave of a pound per MMBtu) and tier4: all that `at_rates` needs to know of a design."""
    held = designs.join(F.broadcast(factors(designs.sparkSession)), ["prime_mover", "fuel"]).where(design_error().isNull())
    held = held.withColumns({f"{p}_lb": F.expr(f"ef_{p} * ({_kept(p)})") for p in pollutants} | {"tier4": has("tier4_final")})
    return held.drop(*(f"ef_{p}" for p in POLLUTANTS))


def coherent(plants: DataFrame) -> DataFrame:
    """The plants that `estimate` keeps, without their emissions: movers, fuels and controls are few, so they are judged once a design."""
    key = ["prime_mover", "fuel", "controls"]
    kept = written(rated(plants.select(*key).distinct(), ()).select(*key))
    return plants.where(size_error().isNull()).join(kept, key, "left_semi")


def at_rates(plants: DataFrame, pollutants: tuple[str, ...] = CRITERIA) -> DataFrame:
    """plants with the columns of `rated`, with what `estimate` adds, to the last bit, of these pollutants.

    Few designs are shared by many plants, so controls are looked through once a design and a plant costs a few products.
    """
    held = plants.where(size_error().isNull()).withColumns({
        "effective_hours": F.expr("if(enforceable, run_hours, 8760D)"), "heat_input": F.expr("mw * 1000 * coalesce(nullif(heat_rate, 0D), heat_rate_default) / 1e6D"),
    })
    lb_hr = {p: f"if(tier4, {TIER4[p]!r}D * mw * 1000 / {GRAMS_PER_LB!r}D, {p}_lb * heat_input)" if p in TIER4 else f"({p}_lb * heat_input)" for p in pollutants}
    amounts = {f"{p}_tpy": F.expr(f"{lb_hr[p]} * effective_hours / 2000") for p in pollutants}
    return held.withColumns(amounts).drop("heat_rate_default", "tier4", *(f"{p}_lb" for p in pollutants))


#: SQL: struct(tpy, order, name) of the largest criteria pollutant, the first in order on ties.
LARGEST_CRITERIA = f"array_max(array({', '.join(f"named_struct('tpy', {p}_tpy, 'order', {-i}, 'name', '{p}')" for i, p in enumerate(CRITERIA))}))"
#: SQL: the pollutants at or over their significant rate, in order.
SIGNIFICANT_ONES = f"array_compact(array({', '.join(f"if({p}_tpy >= {rate!r}D, '{p}', null)" for p, rate in SIGNIFICANT.items())}))"


def largest_criteria() -> Column:
    return F.expr(LARGEST_CRITERIA)


def significant() -> Column:
    return F.expr(SIGNIFICANT_ONES)


def hours_to_hold(pollutant_tpy: Column, target: float | Column, hours: Column) -> Column:
    """Yearly hours that hold a pollutant at target; null if it is under already or less than an hour would be left."""
    full = pollutant_tpy * 8760 / hours
    held = 8760 * target / full
    return F.when((full > target) & (held >= 1), held)


#: DuckDB: the same estimate as a common table expression over `plants`.
def sql() -> str:
    rows = ", ".join(
        "(" + ", ".join([f"'{m}'", f"'{f}'", *(f"{x!r}::DOUBLE" for x in (HEAT_RATES[m], *ef))]) + ")" for (m, f), ef in EMISSION_FACTORS.items()
    )
    names = ", ".join(["m", "f", "hr", *(f"ef_{p}" for p in POLLUTANTS)])
    parts = []
    for p in POLLUTANTS:
        kept = "".join(
            f" * power({1 - eff[p]!r}::DOUBLE, len(list_filter(controls, lambda c: c = '{control}')))" for control, eff in CONTROL_EFFICIENCY.items() if p in eff
        )
        x = f"ef_{p}{kept} * heat_input"
        if p in TIER4:
            x = f"CASE WHEN list_contains(controls, 'tier4_final') THEN {TIER4[p]!r}::DOUBLE * mw * 1000 / {GRAMS_PER_LB}::DOUBLE ELSE {x} END"
        parts.append(f"CASE WHEN rejected IS NULL THEN ({x}) * effective_hours / 2000 END AS {p}_tpy")
    return f"""pte_all AS (
  SELECT * EXCLUDE ({names}), {", ".join(parts)}
  FROM (SELECT *, CASE WHEN enforceable THEN run_hours ELSE 8760 END AS effective_hours,
               mw * 1000 * coalesce(nullif(heat_rate, 0), hr) / 1000000 AS heat_input,
               CASE WHEN mw <= 0 THEN 'mw' WHEN run_hours <= 0 OR run_hours > 8760 THEN 'run_hours'
                    WHEN fuel = 'diesel' AND prime_mover IN ('recip_lean_burn', 'recip_rich_burn', 'fuel_cell') THEN 'no_diesel'
                    WHEN fuel = 'natural_gas' AND prime_mover = 'diesel_recip' THEN 'needs_diesel'
                    WHEN list_contains(controls, 'tier4_final') AND prime_mover <> 'diesel_recip' THEN 'tier4_not_engine'
                    WHEN (list_contains(controls, 'dry_low_nox') OR list_contains(controls, 'water_injection')) AND NOT contains(prime_mover, 'turbine') THEN 'turbine_only_control'
                    WHEN ef_nox IS NULL THEN 'no_factors' END AS rejected
        FROM plants LEFT JOIN (VALUES {rows}) AS ef({names}) ON m = prime_mover AND f = fuel)),
pte AS (SELECT * FROM pte_all WHERE rejected IS NULL)"""
