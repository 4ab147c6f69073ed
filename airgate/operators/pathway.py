"""The permit pathway of a plant at a site, its triggers, hard stops and months, as column expressions over wide rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgate.functions.rules import (
    CITATIONS, CRITERIA, EJ_STATES, NA_THRESHOLDS, OFFSETS, OTR_STATES, OTR_THRESHOLD, OTR_VA, OVERLAYS, PATHWAYS, PBR_HEAT, PBR_TPY, PRECURSORS, SEVERITY,
)
from airgate.operators import emissions
from airgate.operators.emissions import LARGEST_CRITERIA, SIGNIFICANT_ONES, largest_criteria
from airgate.operators.graph import written

#: Designated pollutants, in the order in which hits on them are compared.
DESIGNATED = tuple(PRECURSORS)
#: Kinds of county that names end in, in the order in which they are tried.
COUNTY_KINDS = (" county", " parish", " borough", " census area", " municipality", " city and borough", " city")


def worst_designations(designations: DataFrame, year: str = "yr2026") -> DataFrame:
    """fips and <pollutant>_class: of a county's designations in force the severest class per pollutant, the first on ties."""
    force = designations.where((F.col("nonattain") == "Yes") & (F.col("revoked_na") == "") & (F.trim(F.col(year)) != ""))
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("classification"))
    worst = force.groupBy("fips", "pollutant").agg(F.min(F.struct(rank.alias("rank"), "row_id", "classification")).alias("w"))
    return worst.groupBy("fips").pivot("pollutant", list(DESIGNATED)).agg(F.first("w.classification")).withColumnsRenamed({p: f"{p}_class" for p in DESIGNATED})


def bare_county(county: Column) -> Column:
    """A county's name without the first of COUNTY_KINDS that it ends in, whatever its case."""
    name = F.trim(county)
    out = name
    for kind in reversed(COUNTY_KINDS):
        out = F.when(F.lower(name).endswith(kind), F.trim(F.substring(name, F.lit(1), F.length(name) - len(kind)))).otherwise(out)
    return out


def with_overlay(sites: DataFrame) -> DataFrame:
    """sites with multiplier, permit_by_rule, state_toxics, otr and ej of their state, or the federal default.

    States match in any case, counties without their kind ("Alexandria city" is Alexandria).
    """
    state = F.upper("state")

    def of(k: int, default) -> Column:
        out = F.lit(default)
        for name, row in OVERLAYS.items():
            out = F.when(state == name, row[k]).otherwise(out)
        return out

    otr = state.isin(*OTR_STATES) | ((state == "VA") & bare_county(F.col("county")).isin(*OTR_VA))
    return sites.withColumns({"multiplier": of(0, 1.0), "permit_by_rule": of(1, False), "state_toxics": of(2, False), "otr": otr, "ej": state.isin(*EJ_STATES)})


#: A listed source category (a combined cycle over 250 MMBtu/hr) is major at 100 tpy, others at 250.
SOURCE_THRESHOLD = "if(prime_mover = 'combined_cycle_turbine' and heat_input > 250, 100D, 250D)"


def source_threshold() -> Column:
    return F.expr(SOURCE_THRESHOLD)


def _by_class(pollutant: str, held: dict[str, float], default: float) -> str:
    """SQL: what a designation's class stands for; null without a designation."""
    cases = " ".join(f"when {pollutant}_class = '{name}' then {x!r}D" for name, x in held.items())
    return f"case when {pollutant}_class is null then null {cases} else {default!r}D end"


def na_threshold(pollutant: str) -> str:
    """SQL: the major threshold of a designation's class: the class, else unclassified, else 100."""
    return _by_class(pollutant, NA_THRESHOLDS[pollutant], NA_THRESHOLDS[pollutant].get("unclassified", 100.0))


def _hits() -> str:
    """SQL: of all nonattainment hits that with the greatest tpy over threshold, the first in order on ties; null without."""
    rows = []

    def hit(on: str, limit: str, name: str, grade: str) -> None:
        rows.append(f"if({on} and {name}_tpy >= {limit}, named_struct('ratio', {name}_tpy / {limit}, 'order', {-len(rows)}, 'name', '{name}', 'tpy', {name}_tpy, 'limit', {limit}, 'grade', {grade}), null)")

    for designated, emitted in PRECURSORS.items():
        for p in emitted:
            hit(f"{designated}_class is not null", na_threshold(designated), p, f"{designated}_class")
    for p in ("nox", "voc"):
        hit("otr and ozone_class is null", f"{OTR_THRESHOLD!r}D", p, "'moderate'")
    return f"array_max(array_compact(array({', '.join(rows)})))"


def decide(pairs: DataFrame) -> DataFrame:
    """pairs of a plant's emissions and a site, with the decision.

    Adds threshold, pathway, rank, controlling pollutant with its tpy and threshold, offsets, triggers (fired ones, with
    months), stops, months_low, months_likely, months_high and bact (significant pollutants of a major source). A site
    without designations counts as attainment. All of it is one projection: no shuffle, no Python. It is told in SQL, a layer
    at a time, since each layer is parsed and analysed once, however many rules it has. array_compact, which is a lambda,
    keeps the projection out of whole-stage code on purpose: there it would be one method, longer than the JVM compiles, and
    takes three times as long (33 s against 11 s for 566,000 plants); on its own it is cut into short ones.
    """
    ratio = f"case {' '.join(f"when hit.grade = '{name}' then {x!r}D" for name, x in OFFSETS.items())} else 1D end"
    rank = f"""case when hit is not null then 4 when largest.tpy >= threshold then 3 when enforceable and run_hours < 8760 then 2
      when permit_by_rule and largest.tpy < {PBR_TPY!r}D and heat_input <= {PBR_HEAT!r}D then 0 else 1 end"""
    by_rank = lambda k: f"array({', '.join(repr(p[k]) if k == 0 else f'{p[k]!r}D' for p in PATHWAYS)})[rank]"
    layers = [
        {"threshold": SOURCE_THRESHOLD, "hit": _hits(), "largest": LARGEST_CRITERIA},
        {"rank": rank, "offset_ratio": f"if(hit is not null, {ratio}, null)"},
        {
            "pathway": by_rank(0), "controlling": "coalesce(hit.name, largest.name)", "controlling_tpy": "coalesce(hit.tpy, largest.tpy)",
            "applicable": "coalesce(hit.limit, threshold)", "offsets_tons": "hit.tpy * offset_ratio", "major": "rank >= 3",
        },
        {"triggers": triggers(), "stops": hard_stops(), "added": " + ".join(f"if({fires}, {months}, 0D)" for _, fires, months in RULES)},
        {f"months_{name}": f"{by_rank(2 + k)} * multiplier + added * {share!r}D" for k, (name, share) in enumerate((("low", 0.5), ("likely", 1.0), ("high", 1.5)))}
        | {"bact": f"if(major, {SIGNIFICANT_ONES}, cast(array() as array<string>))"},
    ]
    d = pairs
    for layer in layers:
        d = d.withColumns({name: F.expr(sql) for name, sql in layer.items()})
    return d.drop("hit", "largest")


def _rules() -> list[tuple[str, str, str]]:
    gas, most = "gas_pipeline_km", f"greatest({', '.join(f'{p}_tpy' for p in CRITERIA)})"
    rows = [("nonattainment_designation", f"({' or '.join(f'{p}_class is not null' for p in DESIGNATED)})", "0D")]
    rows += [(p[0], f"rank = {p[1]}", "6D" if p[1] == 4 else "0D") for p in PATHWAYS]
    rows.append(("class_i_aqrv", "class_i_km <= 300", "if(major, if(class_i_km <= 100, 6D, 2D), 0D)"))
    rows += [("psd_increment_consumed", f"{used} >= 0.5D", f"if(major, if({used} >= 0.8D, 6D, 2D), 0D)") for used in ("increment_no2", "increment_pm25")]
    return [
        *rows,
        ("title_v", f"({most} >= 100 or hcho_tpy >= 10)", "0D"),
        ("nsps_turbine", "contains(prime_mover, 'turbine')", "0D"),
        ("nsps_rice", "contains(prime_mover, 'recip')", "0D"),
        ("state_toxics", "state_toxics", "2D"),
        ("ozone_transport_region", "otr", "3D"),
        ("ej_denial_authority", "ej", "4D"),
        ("complex_terrain", "terrain_relief_m > 150", "2D"),
        ("county_moratorium", "moratorium", "0D"),
        ("zoning_posture", "zoning_posture = 'hostile'", "6D"),
        ("litigation", "cases > 0", "3D"),
        ("gas_reachability", f"(fuel = 'natural_gas' and {gas} > 8)", f"if({gas} > 25, 12D, 4D)"),
        ("source_aggregation_risk", "units > 1", "3D"),
    ]


#: (name, whether it fires, the months that it then adds) of each trigger rule, in order, as SQL.
RULES = tuple(_rules())


def rules() -> list[tuple[str, Column, Column]]:
    """RULES as columns."""
    return [(name, F.expr(fires), F.expr(months)) for name, fires, months in RULES]


def triggers() -> str:
    """SQL: the fired triggers as struct(name, months), in rule order."""
    return f"array_compact(array({', '.join(f"if({fires}, named_struct('name', '{name}', 'months', {months}), null)" for name, fires, months in RULES)}))"


def reasons() -> Column:
    """The chain of reasons as struct(name, fired, months, citation), unfired steps too, in rule order.

    The five pathway rules are one step, the pathway that was found. A rule whose input is null has not fired.
    """
    ways = [p[0] for p in PATHWAYS]
    cited = F.lit(None).cast("string")
    for way in ways:
        cited = F.when(F.col("pathway") == way, CITATIONS[way]).otherwise(cited)
    months = F.when(F.col("rank") == 4, 6.0).otherwise(0.0)
    step = lambda name, fired, added, law: F.struct(name.alias("name"), fired.alias("fired"), added.alias("months"), law.alias("citation"))
    chain = []
    for name, fires, added in rules():
        if name not in ways:
            fired = F.coalesce(fires, F.lit(False))
            chain.append(step(F.lit(name), fired, F.when(fired, added).otherwise(0.0), F.lit(CITATIONS[name])))
        elif name == ways[0]:
            chain.append(step(F.col("pathway"), F.col("pathway").isNotNull(), months, cited))
    return F.array(*chain)


def reason_rows(decided: DataFrame, *keys: str) -> DataFrame:
    """keys, place (from 1), name, fired, months, citation: a row for each step of each decision's chain of reasons."""
    long = decided.select(*keys, F.posexplode(reasons()).alias("pos", "r"))
    return long.select(*keys, (F.col("pos") + 1).alias("place"), "r.*")


def trigger_counts(decided: DataFrame) -> DataFrame:
    """name, n: how many decisions each trigger fires in, counted rule by rule in one pass; a rule that fires twice counts twice."""
    held = rules()
    counts = decided.agg(*[F.count_if(fires).alias(f"n{k}") for k, (_, fires, _) in enumerate(held)])
    long = counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"n{k}").alias("n")) for k, (name, _, _) in enumerate(held)])))
    return long.groupBy("name").agg(F.sum("n").alias("n")).where("n > 0")


def months_by_rule(met: DataFrame, *names: str) -> DataFrame:
    """name, n, months: in how many decisions each of these rules fires and the months that it adds in all.

    Each row of met stands for n decisions. It has what these rules look at, so they needn't be decided for rules on sites and fuels.
    """
    held = [(name, F.expr(fires), F.expr(months)) for name, fires, months in RULES if name in names]
    counts = [F.sum(F.when(fires, F.col("n"))).alias(f"n{k}") for k, (_, fires, _) in enumerate(held)]
    sums = met.agg(*counts, *[F.sum(F.when(fires, months * F.col("n"))).alias(f"months{k}") for k, (_, fires, months) in enumerate(held)])
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"n{k}").alias("n"), F.col(f"months{k}").alias("months")) for k, (name, *_) in enumerate(held)])
    return sums.select(F.inline(rows)).groupBy("name").agg(F.sum("n").alias("n"), F.sum("months").alias("months")).where("n > 0")


def hard_stops() -> str:
    """SQL: the names of what stops a plant at a site."""
    stops = (
        ("offsets", "offset_ratio >= 1.3D"), ("increment_no2", "increment_no2 >= 0.95D"), ("increment_pm25", "increment_pm25 >= 0.95D"),
        ("ej_residents", "ej and residents_1km > 500"), ("moratorium", "moratorium"), ("gas", "fuel = 'natural_gas' and gas_pipeline_km > 25"),
    )
    return f"array_compact(array({', '.join(f"if({on}, '{name}', null)" for name, on in stops)}))"


def class_limits() -> list[Column]:
    """For each of DESIGNATED the threshold of a site's class (100 for a class without one); null without a designation."""
    limits = []
    for p in DESIGNATED:
        out = F.lit(100.0)
        for name, x in NA_THRESHOLDS[p].items():
            out = F.when(F.col(f"{p}_class") == name, x).otherwise(out)
        limits.append(F.when(F.col(f"{p}_class").isNotNull(), out))
    return limits


def synthetic_cap(least_hours: float = 1000.0, margin: float = 0.9) -> dict[str, Column]:
    """cap_threshold, cap_hours and cap_feasible: the hours that hold the largest pollutant a margin under every threshold.

    The threshold is the least of the source category's and of each designation's class (100 for a class without one);
    the transport region's is not among them. cap_hours is null for a plant that is under the target already.
    """
    target, full = F.least(source_threshold(), *class_limits()), largest_criteria()["tpy"] * 8760 / F.col("effective_hours")
    hours = F.when(full > target * margin, 8760 * target * margin / full)
    return {"cap_threshold": target, "cap_hours": hours, "cap_feasible": hours >= least_hours}


# ---- decisions in brief: rank, months and the number of stops, for searches and sweeps that decide a plant at many sites


#: The emitted pollutants that a designation can be hit by.
EMITTED = tuple(dict.fromkeys(p for held in PRECURSORS.values() for p in held))
#: Classes with an offset ratio that stops a plant.
_STRICT = ", ".join(f"'{name}'" for name, ratio in OFFSETS.items() if ratio >= 1.3)
#: What the site's part of a decision can depend on: rank, whether the fuel is gas, whether there is more than one unit.
_KINDS = tuple((rank, gas, units) for rank in range(len(PATHWAYS)) for gas in (0, 1) for units in (1, 2))
#: How many of them there are.
CELLS = len(_KINDS)
#: The emitted pollutants that offsets can stop a plant for, and the others.
HARD = tuple(p for p in EMITTED if any(p in emitted and any(OFFSETS.get(c, 1.0) >= 1.3 for c in NA_THRESHOLDS[d]) for d, emitted in PRECURSORS.items()))
SOFT = tuple(p for p in EMITTED if p not in HARD)


def _said(sql: str, rank: int, gas: int, units: int) -> str:
    """SQL of the rules with a plant's part put in; emissions and movers are left at nothing, as no months hang on them."""
    held = {"rank": str(rank), "major": str(rank >= 3).lower(), "fuel": "'natural_gas'" if gas else "'none'", "units": str(units), "prime_mover": "''", "offset_ratio": "cast(null as double)"}
    held |= {f"{p}_tpy": "0D" for p in (*CRITERIA, "hcho")}
    return re.sub(rf"\b({'|'.join(held)})\b", lambda m: held[m[0]], sql)


def in_brief(located: DataFrame, *keys: str) -> DataFrame:
    """keys and `site`: what `brief` needs of each site with its overlay and designations, by the rules of `decide`.

    For each pollutant the least threshold that it can hit here, with its place among the hits and whether its offsets stop
    a plant; months and stops for each of the few kinds of plant that a site tells apart.
    """
    slots = [(f"{d}_class is not null", na_threshold(d), p, f"coalesce({d}_class in ({_STRICT}), false)") for d, emitted in PRECURSORS.items() for p in emitted]
    slots += [("otr and ozone_class is null", f"{OTR_THRESHOLD!r}D", p, "false") for p in ("nox", "voc")]
    d = located.withColumns({f"_limit{k}": F.expr(f"if({on}, {limit}, null)") for k, (on, limit, _, _) in enumerate(slots)})
    fields, strict = [], []
    for p in EMITTED:
        mine = [(k, hard) for k, (_, _, of, hard) in enumerate(slots) if of == p]
        least = f"least({', '.join(f'_limit{k}' for k, _ in mine)}, double('infinity'))"
        code = f"case {' '.join(f'when _limit{k} = {least} then {2 * k} + if({hard}, 0, 1)' for k, hard in mine)} end"
        fields += [f"{least} as {p}_at", f"{code} as {p}_code"]
        strict += [f"(_limit{k} is not null and {hard})" for k, hard in mine]
    by_rank = [f"{p[3]!r}D * multiplier" for p in PATHWAYS]
    months = ", ".join(f"{by_rank[kind[0]]} + ({' + '.join(_said(f'if({fires}, {more}, 0D)', *kind) for _, fires, more in RULES)})" for kind in _KINDS)
    stops = ", ".join(f"size({_said(hard_stops(), 0, gas, 1)})" for gas in (0, 1))
    fields += ["coalesce(permit_by_rule, false) as by_rule", f"({' or '.join(strict)}) as strict", f"array({months}) as months", f"array({stops}) as stops"]
    parts = [f.rsplit(" as ", 1) for f in fields]
    return d.select(*keys, F.struct(*[F.expr(sql).alias(name) for sql, name in parts]).alias("site"))


#: SQL of a plant's kind: whether its fuel is gas and whether it has more than one unit.
KIND = "(if(fuel = 'natural_gas', 2, 0) + if(units > 1, 1, 0))"


def design_in_brief(pte: DataFrame) -> DataFrame:
    """pte with what `brief` needs of a plant: rank_plain and rank_by_rule (its rank without a hit, without and with a permit by rule) and kind."""
    d = pte.withColumn("_most", F.greatest(*[f"{p}_tpy" for p in CRITERIA]))
    plain = f"case when _most >= {SOURCE_THRESHOLD} then 3 when enforceable and run_hours < 8760 then 2"
    d = d.withColumns({
        "rank_plain": F.expr(f"{plain} else 1 end"), "rank_by_rule": F.expr(f"{plain} when _most < {PBR_TPY!r}D and heat_input <= {PBR_HEAT!r}D then 0 else 1 end"),
        "kind": F.expr(KIND),
    })
    return d.drop("_most")


def limits(site: str = "site") -> dict[str, str]:
    """SQL of what a `site` of `in_brief` says of thresholds: all that hits and stops by offsets hang on. least_at is the least of all,
    soft_at of SOFT, hard_at the greatest of HARD where each of them is one whose offsets stop a plant."""
    at, least = lambda p: f"{site}.{p}_at", lambda of: of[0] if len(of) == 1 else f"least({', '.join(of)})"
    hard, most = " and ".join(f"{site}.{p}_code % 2 = 0" for p in HARD), f"greatest({', '.join(at(p) for p in HARD)}, 0D)"
    held = {f"{p}_{x}": f"{site}.{p}_{x}" for p in EMITTED for x in ("at", "code")} | {"strict": f"{site}.strict"}
    return held | {"least_at": least([at(p) for p in EMITTED]), "soft_at": least([at(p) for p in SOFT]), "hard_at": f"if({hard}, {most}, null)"}


def brief(site: str = "site", best: str = "best") -> dict[str, str]:
    """SQL of a decision by a plant of `design_in_brief` and a `site` of `in_brief`, in the order in which it is worked out.

    best is the greatest ratio of an emission to a threshold, asked for only where offsets can stop a plant; tough whether they
    do (the first hit of that ratio has strict offsets); hit whether any emission is over a threshold. rank, months and n_stops need `best`, `rank` and `tough` before them.
    """
    ratio, hit = lambda p: f"{p}_tpy / {site}.{p}_at", lambda p: f"{p}_tpy >= {site}.{p}_at"
    most = f"greatest({', '.join(f'if({hit(p)}, {ratio(p)}, null)' for p in EMITTED)})"
    first = f"least({', '.join(f'if({ratio(p)} = {best}, {site}.{p}_code, null)' for p in EMITTED)})"
    return {
        "hit": " or ".join(hit(p) for p in EMITTED),
        "best": f"if({site}.strict, {most}, null)",
        "tough": f"if({best} is null, 0, if({first} % 2 = 0, 1, 0))",
        "rank": f"if({' or '.join(hit(p) for p in EMITTED)}, 4, if({site}.by_rule, rank_by_rule, rank_plain))",
        "months": f"{site}.months[rank * 4 + kind]",
        "n_stops": f"{site}.stops[kind div 2] + tough",
    }


def planned_in_brief(plants: DataFrame) -> DataFrame:
    """plants with the `site` that they are planned for, estimated and with rank, months_likely and n_stops by the rules of `decide`.

    Movers, fuels and controls are few: what a design emits is worked out once and kept as a small table, which plants meet.
    """
    key = ["prime_mover", "fuel", "controls"]
    table = written(emissions.rated(plants.select(*key).distinct()))
    return decide_in_brief(emissions.at_rates(plants.join(table, key)))


def decide_in_brief(pte: DataFrame) -> DataFrame:
    """pte with its `site` (of `in_brief`), with rank, months_likely and n_stops by the rules of `decide`.

    As in `decide`, array_compact, a lambda, keeps these projections out of whole-stage code, where all of them together would
    be one method that is longer than the JVM compiles; it is reached only where offsets can stop a plant.
    """
    told, d = brief(), design_in_brief(pte)
    for name in ("best", "tough"):
        told[name] = re.sub(r"(greatest|least)\((if\(.*, null\))\)", lambda m: f"array_{'max' if m[1] == 'greatest' else 'min'}(array_compact(array({m[2]})))", told[name])
    for name in ("best", "tough", "rank", "months", "n_stops"):
        d = d.withColumn(name, F.expr(told[name]))
    return d.withColumnRenamed("months", "months_likely").drop("best", "tough", "rank_plain", "rank_by_rule", "kind")


def pairs(pte: DataFrame, sites: DataFrame, worst: DataFrame) -> DataFrame:
    """Every plant at every site; designations join the sites first, and the smaller side is what a cross join repeats.

    sites is a dimension (one row a county or parcel under study), so Spark's own size check decides on its broadcast.
    """
    return pte.crossJoin(with_overlay(sites).join(worst, "fips", "left"))


def answers(pte: DataFrame, sites: DataFrame, worst: DataFrame) -> DataFrame:
    """Decisions of plants with distinct emissions at distinct site profiles, with how many pairs share each.

    Portfolios repeat designs and counties share facts, so the rules run once a profile and the counts multiply.
    """
    drop = {"plant_id", "l_orderkey", "l_suppkey", "controls"}
    facts = [c for c in pte.columns if c not in drop]
    kinds = pte.groupBy(*facts).agg(F.count("*").alias("n_plants"))
    located = with_overlay(sites).join(worst, "fips", "left").drop("site_id", "fips", "county", "lat", "lon")
    places = located.groupBy(*located.columns).agg(F.count("*").alias("n_sites"))
    return decide(kinds.crossJoin(places)).withColumn("n_pairs", F.col("n_plants") * F.col("n_sites"))


def ranked_candidates(decided: DataFrame, project: str) -> DataFrame:
    """The candidates of each project in order: no stop first, then rank, months, site."""
    order = Window.partitionBy(project).orderBy((F.size("stops") > 0).cast("int"), "rank", "months_likely", "site_id")
    return decided.withColumn("place", F.row_number().over(order))


# ---- DuckDB


def _case(column: str, held: dict, default: str) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {v}" for k, v in held.items())} ELSE {default} END"


def sql(on: str = "true") -> str:
    """worst and decided as common table expressions over designations, sites and the plants `chosen`, paired by `on`."""
    severity = ", ".join(f"'{s}'" for s in SEVERITY)
    classes = ", ".join(f"max(classification) FILTER (WHERE pollutant = '{p}') AS {p}_class" for p in DESIGNATED)
    bare = "trim(regexp_replace(trim(county), ' (county|parish|borough|census area|municipality|city)$', '', 'i'))"
    in_otr = f"upper(state) IN ({', '.join(f"'{s}'" for s in OTR_STATES)}) OR (upper(state) = 'VA' AND {bare} IN ({', '.join(f"'{s}'" for s in OTR_VA)}))"
    multiplier = _case("upper(state)", {k: f"{v[0]!r}::DOUBLE" for k, v in OVERLAYS.items()}, "1.0::DOUBLE")
    by_rule = _case("upper(state)", {k: v[1] for k, v in OVERLAYS.items()}, "false")
    toxics = _case("upper(state)", {k: v[2] for k, v in OVERLAYS.items()}, "false")
    hits = []
    for designated, emitted in PRECURSORS.items():
        limits = {k: f"{v!r}::DOUBLE" for k, v in NA_THRESHOLDS[designated].items()}
        limit = _case(f"{designated}_class", limits, limits.get("unclassified", "100.0::DOUBLE"))
        hits += [(f"{designated}_class IS NOT NULL AND {p}_tpy >= {limit}", p, limit, f"{designated}_class") for p in emitted]
    hits += [(f"otr AND ozone_class IS NULL AND {p}_tpy >= 50", p, "50.0::DOUBLE", "'moderate'") for p in ("nox", "voc")]
    ratios = ", ".join(f"CASE WHEN {on} THEN {p}_tpy / {limit} END AS r{k}" for k, (on, p, limit, _) in enumerate(hits))
    best = f"greatest({', '.join(f'r{k}' for k in range(len(hits)))})"
    pick = lambda of: "CASE " + " ".join(f"WHEN r{k} = best THEN {of(h)}" for k, h in enumerate(hits)) + " END"
    offsets = _case("hit_grade", {k: f"{v!r}::DOUBLE" for k, v in OFFSETS.items()}, "1.0::DOUBLE")
    most = f"greatest({', '.join(f'{p}_tpy' for p in CRITERIA)})"
    largest = "CASE " + " ".join(f"WHEN {p}_tpy = largest_tpy THEN '{p}'" for p in CRITERIA) + " END"
    months = lambda k: f"[{', '.join(f'{p[k]!r}::DOUBLE' for p in PATHWAYS)}][rank + 1]"
    added = """(CASE WHEN rank = 4 THEN 6 ELSE 0 END + CASE WHEN major AND class_i_km <= 100 THEN 6 WHEN major AND class_i_km <= 300 THEN 2 ELSE 0 END
      + CASE WHEN major AND increment_no2 >= 0.8 THEN 6 WHEN major AND increment_no2 >= 0.5 THEN 2 ELSE 0 END
      + CASE WHEN major AND increment_pm25 >= 0.8 THEN 6 WHEN major AND increment_pm25 >= 0.5 THEN 2 ELSE 0 END
      + CASE WHEN state_toxics THEN 2 ELSE 0 END + CASE WHEN otr THEN 3 ELSE 0 END + CASE WHEN ej THEN 4 ELSE 0 END
      + CASE WHEN terrain_relief_m > 150 THEN 2 ELSE 0 END + CASE WHEN zoning_posture = 'hostile' THEN 6 ELSE 0 END + CASE WHEN cases > 0 THEN 3 ELSE 0 END
      + CASE WHEN fuel = 'natural_gas' AND gas_pipeline_km > 25 THEN 12 WHEN fuel = 'natural_gas' AND gas_pipeline_km > 8 THEN 4 ELSE 0 END
      + CASE WHEN units > 1 THEN 3 ELSE 0 END)::DOUBLE"""
    return f"""worst_long AS (
  SELECT fips, pollutant, arg_min(classification, list_position([{severity}], classification)::BIGINT * 1000000000 + row_id) AS classification
  FROM designations WHERE nonattain = 'Yes' AND revoked_na = '' AND trim(yr2026) <> '' GROUP BY fips, pollutant),
worst AS (SELECT fips, {classes} FROM worst_long GROUP BY fips),
located AS (
  SELECT s.*, w.* EXCLUDE (fips), {multiplier} AS multiplier, {by_rule} AS permit_by_rule, {toxics} AS state_toxics, {in_otr} AS otr, upper(state) IN ('NJ') AS ej
  FROM sites s LEFT JOIN worst w ON s.fips = w.fips),
pairs AS (SELECT chosen.*, located.* FROM chosen JOIN located ON {on}),
hits AS (
  SELECT *, CASE WHEN prime_mover = 'combined_cycle_turbine' AND heat_input > 250 THEN 100.0::DOUBLE ELSE 250.0::DOUBLE END AS threshold,
         {most} AS largest_tpy, {ratios} FROM pairs),
best AS (SELECT *, {best} AS best FROM hits),
found AS (
  SELECT *, {pick(lambda h: f"'{h[1]}'")} AS hit_name, {pick(lambda h: f"{h[1]}_tpy")} AS hit_tpy, {pick(lambda h: h[2])} AS hit_limit,
         {pick(lambda h: h[3])} AS hit_grade, {largest} AS largest_name FROM best),
ruled AS (
  SELECT *, CASE WHEN best IS NOT NULL THEN 4 WHEN largest_tpy >= threshold THEN 3 WHEN enforceable AND run_hours < 8760 THEN 2
                 WHEN permit_by_rule AND largest_tpy < 25 AND heat_input <= 100 THEN 0 ELSE 1 END AS rank,
         CASE WHEN best IS NOT NULL THEN {offsets} END AS offset_ratio FROM found),
timed AS (SELECT *, rank >= 3 AS major FROM ruled),
decided AS (
  SELECT *, [{", ".join(f"'{p[0]}'" for p in PATHWAYS)}][rank + 1] AS pathway, coalesce(hit_name, largest_name) AS controlling,
         coalesce(hit_tpy, largest_tpy) AS controlling_tpy, coalesce(hit_limit, threshold) AS applicable, hit_tpy * offset_ratio AS offsets_tons,
         {added} AS added,
         {months(2)} * multiplier + {added} * 0.5 AS months_low, {months(3)} * multiplier + {added} AS months_likely, {months(4)} * multiplier + {added} * 1.5 AS months_high,
         (coalesce(offset_ratio >= 1.3, false)::INT + (increment_no2 >= 0.95)::INT + (increment_pm25 >= 0.95)::INT + (ej AND residents_1km > 500)::INT
          + moratorium::INT + coalesce(fuel = 'natural_gas' AND gas_pipeline_km > 25, false)::INT) AS n_stops
  FROM timed)"""


def deltas(decided: DataFrame, project: str) -> DataFrame:
    """Every candidate of a project against its first, by site_id and plant_id: pathways, rank_change and months_saved
    (more is better), and the hard stops and triggers that are cleared and added. The first itself has no row."""
    held = decided.select(project, "site_id", "plant_id", "pathway", "rank", "months_likely", F.transform("triggers", lambda t: t["name"]).alias("triggers"), "stops")
    place = F.struct("site_id", "plant_id")
    facts = F.struct(place.alias("place"), "pathway", "rank", "months_likely", "triggers", "stops")
    # The first is read off beside the others: plants are decided, and travel, once.
    inside = Window.partitionBy(project).orderBy("site_id", "plant_id")
    d = held.where(F.col(project).isNotNull()).withColumn("base", F.first(facts).over(inside)).where(place != F.col("base.place"))
    less = lambda a, b: F.array_sort(F.array_except(a, b))
    return d.select(
        project, "site_id", "plant_id", F.col("base.pathway").alias("pathway_from"), F.col("pathway").alias("pathway_to"),
        (F.col("base.rank") - F.col("rank")).alias("rank_change"), F.round(F.col("base.months_likely") - F.col("months_likely"), 1).alias("months_saved"),
        *[x for c in ("stops", "triggers") for x in (less(F.col(f"base.{c}"), F.col(c)).alias(f"{c}_cleared"), less(F.col(c), F.col(f"base.{c}")).alias(f"{c}_added"))],
    )
