"""Whole jobs: operators put together over the given tables."""
