"""Where jobs are registered with the SQL that they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    """Registers a job under its name; jobs that SQL can't express have none."""

    def keep(job: Job) -> Job:
        QUERIES[job.__name__] = job
        if sql is not None:
            ORACLES[job.__name__] = sql
        return job

    return keep


def shown(x: str | Column, places: int = 4) -> Column:
    """Rounded for output, as the SQL engine does it: scaled, rounded to a whole number and scaled back, in doubles.

    round(x, places) would round the decimal digits, and differ where scaling turns a number just under a half into one.
    """
    scale = float(10**places)
    return F.round(((F.col(x) if isinstance(x, str) else x) + 1e-7) * scale) / scale
