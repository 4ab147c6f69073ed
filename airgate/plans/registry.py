"""All registered queries by name, and the SQL each must equal."""

from __future__ import annotations

from airgate.plans import bodies, details, extra, markets, more, newsroom, permit, screening, shapes, signals, siting, streams  # noqa: F401  each registers its jobs
from airgate.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
