"""Meteorological Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STD_FLOOR = 1e-6
EARTH_M = 6_371_000.0


def finite(x: Column) -> Column:
    """NaN and infinities become NULL: NULL is the only missing value past the sources."""
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), None).otherwise(x)


def z_score(x: Column, mean: Column, std: Column, floor: float = STD_FLOOR) -> Column:
    return (x - mean) / F.greatest(std, F.lit(floor))


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def vapour_pressure(t_c: Column) -> Column:
    """Saturation vapour pressure in hPa over water."""
    return 6.112 * F.exp(17.67 * t_c / (t_c + 243.5))


def relative_humidity(t_c: Column, dew_c: Column) -> Column:
    return 100 * vapour_pressure(dew_c) / vapour_pressure(t_c)
