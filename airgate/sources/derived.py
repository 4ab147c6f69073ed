"""Permit inputs derived from the given star-schema tables: plants, sites, designations, posture.

The given tables carry no permit data, so each input is a fixed function of one of them; the work grows with the tables.
Each input comes with the same derivation in DuckDB SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgate.functions.rules import MOVERS

#: The states that the 25 nation keys stand for: the modelled ones, some of the transport region, and others.
STATES = "VA TX GA OH AZ NJ NM IL CT DE MD NY PA CA NV UT WA OR FL NC SC TN KY IN MI".split()
COUNTIES = 40


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plant_id, mw, prime_mover, fuel, controls, run_hours, enforceable, heat_rate, units; one row a lineitem."""
    return designed(read(spark, sf_dir, "lineitem"))


def designed(li: DataFrame, *more: str) -> DataFrame:
    """The plants of lineitem rows, with what `more` columns the rows bring.

    Designs are wider than the rows that they are made of, so rows are joined first and designed afterwards.
    """
    kind = F.col("l_partkey") % 6
    turbine, bit = kind < 2, lambda n: F.col("l_linenumber").bitwiseAND(n) > 0
    controls = F.array_compact(
        F.array(
            F.when(bit(1) & turbine, "dry_low_nox"),
            F.when(bit(2) & (kind < 5), "scr"),
            F.when(bit(4) & (kind < 5), "oxidation_catalyst"),
            F.when(bit(1) & (kind == 4), "tier4_final"),
        )
    )
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("plant_id"),
        F.col("l_orderkey"),
        F.col("l_suppkey"),
        (F.col("l_quantity") * 12).alias("mw"),
        F.element_at(F.array(*[F.lit(m) for m in MOVERS]), (kind + 1).cast("int")).alias("prime_mover"),
        F.when((kind == 4) | (turbine & (F.col("l_returnflag") == "R")), "diesel").otherwise("natural_gas").alias("fuel"),
        controls.alias("controls"),
        (8760 - F.col("l_suppkey") % 6000).cast("double").alias("run_hours"),
        (F.col("l_linestatus") == "F").alias("enforceable"),
        F.when(F.col("l_quantity") % 7 == 0, 9000.0).when(F.col("l_quantity") % 10 == 0, 0.0).alias("heat_rate"),
        F.when(F.col("l_linenumber") == 7, 2).otherwise(1).alias("units"),
        *more,
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, state, fips, county and the physical and local facts of a site; one row a supplier."""
    k = F.col("s_suppkey")
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("s_nationkey") + 1)
    return read(spark, sf_dir, "supplier").select(
        k.alias("site_id"),
        state.alias("state"),
        F.concat(F.lpad((F.col("s_nationkey") + 1).cast("string"), 2, "0"), F.lpad((k % COUNTIES).cast("string"), 3, "0")).alias("fips"),
        F.when((state == "VA") & (k % 3 == 0), "Loudoun").otherwise(F.concat(F.lit("County "), (k % COUNTIES).cast("string"))).alias("county"),
        (25 + (k * 7919) % 24000 / 1000).alias("lat"),
        (-124 + (k * 104729) % 57000 / 1000).alias("lon"),
        (k * 37 % 1500).alias("residents_1km"),
        (k * 13 % 300).cast("double").alias("terrain_relief_m"),
        F.when(k % 9 != 0, (k * 7 % 40).cast("double")).alias("gas_pipeline_km"),
        (k % 23 == 0).alias("moratorium"),
        F.when(k % 7 == 0, "hostile").when(k % 7 == 1, "special-exception").otherwise("by-right").alias("zoning_posture"),
        (k % 11 == 0).cast("int").alias("cases"),
        F.when(k % 5 != 0, (k * 17 % 400).cast("double")).alias("class_i_km"),
        ((k * 29 % 100) / 100).alias("increment_no2"),
        ((k * 31 % 100) / 100).alias("increment_pm25"),
    )


def designations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string designation rows, several a county, pollutant and standard; one row a part."""
    k = F.col("p_partkey")
    pollutant = F.element_at(F.array(*[F.lit(p) for p in ("ozone", "pm25", "pm10", "co", "so2", "no2", "lead")]), F.col("p_size") % 7 + 1)
    grade = F.element_at(F.array(*[F.lit(c) for c in ("marginal", "moderate", "serious", "severe-15", "extreme")]), (k % 5 + 1).cast("int"))
    plain = F.element_at(F.array(*[F.lit(c) for c in ("moderate", "serious", "unclassified")]), (k % 3 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(
        k.alias("row_id"),
        F.concat(F.lpad((k % 25 + 1).cast("string"), 2, "0"), F.lpad((k * 7 % COUNTIES).cast("string"), 3, "0")).alias("fips"),
        pollutant.alias("pollutant"),
        F.when(pollutant == "ozone", grade).when(pollutant.isin("so2", "no2", "lead"), "unclassified").otherwise(plain).alias("classification"),
        F.col("p_name").alias("area_name"),
        F.when(F.col("p_size") % 2 == 1, "P").otherwise("W").alias("part"),
        F.when(k % 10 != 3, "Yes").otherwise("").alias("nonattain"),
        F.when(k % 10 == 4, "Revoked").otherwise("").alias("revoked_na"),
        F.when(k % 4 != 1, "26").otherwise("").alias("yr2026"),
        F.concat(F.lit("A"), (k % 50).cast("string")).alias("composid"),
    )


_LIST = ", ".join

SQL = {
    "plants": f"""plants AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS plant_id, l_orderkey, l_suppkey, l_quantity * 12 AS mw,
         [{_LIST(f"'{m}'" for m in MOVERS)}][(l_partkey % 6 + 1)::INT] AS prime_mover,
         CASE WHEN l_partkey % 6 = 4 OR (l_partkey % 6 < 2 AND l_returnflag = 'R') THEN 'diesel' ELSE 'natural_gas' END AS fuel,
         list_filter([CASE WHEN l_linenumber & 1 > 0 AND l_partkey % 6 < 2 THEN 'dry_low_nox' END,
                      CASE WHEN l_linenumber & 2 > 0 AND l_partkey % 6 < 5 THEN 'scr' END,
                      CASE WHEN l_linenumber & 4 > 0 AND l_partkey % 6 < 5 THEN 'oxidation_catalyst' END,
                      CASE WHEN l_linenumber & 1 > 0 AND l_partkey % 6 = 4 THEN 'tier4_final' END], lambda x: x IS NOT NULL) AS controls,
         (8760 - l_suppkey % 6000)::DOUBLE AS run_hours, l_linestatus = 'F' AS enforceable,
         CASE WHEN l_quantity % 7 = 0 THEN 9000.0::DOUBLE WHEN l_quantity % 10 = 0 THEN 0.0::DOUBLE END AS heat_rate,
         CASE WHEN l_linenumber = 7 THEN 2 ELSE 1 END AS units
  FROM lineitem)""",
    "sites": f"""sites AS (
  SELECT s_suppkey AS site_id, [{_LIST(f"'{s}'" for s in STATES)}][s_nationkey + 1] AS state,
         lpad((s_nationkey + 1)::VARCHAR, 2, '0') || lpad((s_suppkey % {COUNTIES})::VARCHAR, 3, '0') AS fips,
         CASE WHEN s_nationkey = 0 AND s_suppkey % 3 = 0 THEN 'Loudoun' ELSE 'County ' || (s_suppkey % {COUNTIES})::VARCHAR END AS county,
         25 + (s_suppkey * 7919) % 24000 / 1000::DOUBLE AS lat, -124 + (s_suppkey * 104729) % 57000 / 1000::DOUBLE AS lon,
         s_suppkey * 37 % 1500 AS residents_1km, (s_suppkey * 13 % 300)::DOUBLE AS terrain_relief_m,
         CASE WHEN s_suppkey % 9 <> 0 THEN (s_suppkey * 7 % 40)::DOUBLE END AS gas_pipeline_km, s_suppkey % 23 = 0 AS moratorium,
         CASE WHEN s_suppkey % 7 = 0 THEN 'hostile' WHEN s_suppkey % 7 = 1 THEN 'special-exception' ELSE 'by-right' END AS zoning_posture,
         (s_suppkey % 11 = 0)::INT AS cases, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey * 17 % 400)::DOUBLE END AS class_i_km,
         (s_suppkey * 29 % 100) / 100::DOUBLE AS increment_no2, (s_suppkey * 31 % 100) / 100::DOUBLE AS increment_pm25
  FROM supplier)""",
    "designations": f"""designations AS (
  SELECT row_id, fips, pollutant,
         CASE WHEN pollutant = 'ozone' THEN ['marginal', 'moderate', 'serious', 'severe-15', 'extreme'][(row_id % 5 + 1)::INT]
              WHEN pollutant IN ('so2', 'no2', 'lead') THEN 'unclassified'
              ELSE ['moderate', 'serious', 'unclassified'][(row_id % 3 + 1)::INT] END AS classification,
         area_name, part, nonattain, revoked_na, yr2026, composid
  FROM (SELECT p_partkey AS row_id, lpad((p_partkey % 25 + 1)::VARCHAR, 2, '0') || lpad((p_partkey * 7 % {COUNTIES})::VARCHAR, 3, '0') AS fips,
               ['ozone', 'pm25', 'pm10', 'co', 'so2', 'no2', 'lead'][p_size % 7 + 1] AS pollutant, p_name AS area_name,
               CASE WHEN p_size % 2 = 1 THEN 'P' ELSE 'W' END AS part, CASE WHEN p_partkey % 10 <> 3 THEN 'Yes' ELSE '' END AS nonattain,
               CASE WHEN p_partkey % 10 = 4 THEN 'Revoked' ELSE '' END AS revoked_na,
               CASE WHEN p_partkey % 4 <> 1 THEN '26' ELSE '' END AS yr2026, 'A' || (p_partkey % 50)::VARCHAR AS composid
        FROM part))""",
}
