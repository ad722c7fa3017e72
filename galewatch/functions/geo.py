"""Distances, bearings and boxes on the sphere, as Column expressions (degrees in, km out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.32


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course in degrees clockwise from north, 0 up to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap of two latitude/longitude boxes in square degrees; 0 where the union has no area."""
    inter = F.greatest(F.least(a["n"], b["n"]) - F.greatest(a["s"], b["s"]), F.lit(0.0)) * F.greatest(
        F.least(a["e"], b["e"]) - F.greatest(a["w"], b["w"]), F.lit(0.0)
    )
    union = (a["n"] - a["s"]) * (a["e"] - a["w"]) + (b["n"] - b["s"]) * (b["e"] - b["w"]) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def box_area_km2(s: Column, n: Column, w: Column, e: Column) -> Column:
    """Height times the width at the southern edge."""
    return haversine_km(s, w, n, w) * haversine_km(s, w, s, e)
