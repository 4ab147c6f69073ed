"""The contract of a fact provider: a DataFrame of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that a provider's facts must have.
FACT_COLUMNS = ("site_id", "key", "value")


def checked(facts: DataFrame) -> DataFrame:
    """The facts, if they have the columns of the contract."""
    missing = [c for c in FACT_COLUMNS if c not in facts.columns]
    if missing:
        raise ValueError(f"a provider's facts lack {', '.join(missing)}")
    return facts


def coverage(sites: DataFrame, facts: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """site_id, facts, state: complete where every needed key was read, else incomplete."""
    read = checked(facts).where(F.col("key").isin(*needed)).groupBy("site_id").agg(F.count("*").alias("facts"), F.countDistinct("key").alias("keys"))
    state = F.when(F.col("keys") == len(needed), "complete").otherwise("incomplete")
    return sites.join(read, "site_id", "left").select("site_id", F.coalesce("facts", F.lit(0).cast("long")).alias("facts"), state.alias("state"))
