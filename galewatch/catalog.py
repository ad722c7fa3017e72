"""Registry of the engine's own queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import contracts, detection, grids, horizons, roundtrips, series, serving, tables

PLANS = (detection, series, grids, serving, contracts, horizons, tables, roundtrips)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for p in PLANS for name, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for p in PLANS for name, sql in p.SQL.items()}
