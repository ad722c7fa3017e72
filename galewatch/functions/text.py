"""Column expressions over names, ranges, rings, maps and nested records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THREAT_ID = r"^THR-[0-9]{4}-[0-9]{4,}$"


def one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    """The allowed name that ``value`` is, whatever its case and the blanks around it; else NULL."""
    folded = F.lower(F.trim(value))
    return F.coalesce(*[F.when(folded == a.lower(), F.lit(a)) for a in allowed], F.lit(None).cast("string"))


def is_threat_id(value: Column) -> Column:
    return F.coalesce(F.regexp_like(value, F.lit(THREAT_ID)), F.lit(False))


def threat_id(year: Column, number: Column) -> Column:
    """THR-<year>-<number>, both padded with zeros to four places."""
    return F.concat(F.lit("THR-"), F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.when(number < 10_000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string")))


def short_number(value: float) -> str:
    """Six significant digits without trailing zeros."""
    return f"{value:g}"


def band_label(q: float, above: Column) -> Column:
    """Name of the side of a quantile that a value is on; the quantile is printed as it is."""
    return F.when(above, f"above_p{short_number(q)}").when(~above, f"below_p{short_number(q)}")


def day_range(text: Column) -> Column:
    """Days of "a-b" (or of "a" alone) as an array; NULL unless both are numbers and a <= b."""
    ends = F.split(text, "-")
    first = F.try_to_number(F.trim(ends[0]), F.lit("999")).cast("int")
    last = F.when(F.size(ends) == 1, first).when(F.size(ends) == 2, F.try_to_number(F.trim(F.get(ends, F.lit(1))), F.lit("999")).cast("int"))
    return F.when(first <= last, F.sequence(first, last))


def ramp_fraction(value: Column, low: Column, high: Column) -> Column:
    """Place of a value between two bounds, clamped to 0 and 1; bounds that do not rise give 1."""
    return F.when(value.isNull(), None).when(high <= low, 1.0).otherwise(F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0)))


def ramp_colour(fraction: Column, start: tuple[int, int, int], end: tuple[int, int, int]) -> Column:
    """#rrggbb on the straight line between two colours."""
    parts = [F.lpad(F.lower(F.hex(F.floor(F.lit(a) + fraction * (b - a) + 0.5).cast("long"))), 2, "0") for a, b in zip(start, end, strict=True)]
    return F.concat(F.lit("#"), *parts)


def ring_problem(ring: Column) -> Column:
    """What is wrong with a ring of (longitude, latitude) pairs, the first thing only; NULL if nothing is."""
    pairs = F.forall(ring, lambda p: F.size(p) == 2)
    inside = F.forall(ring, lambda p: p[0].between(-180, 180) & p[1].between(-90, 90))
    return (
        F.when(ring.isNull(), "missing")
        .when(F.size(ring) < 4, "fewer than four points")
        .when(~pairs, "not pairs")
        .when(~F.coalesce(F.element_at(ring, 1) == F.element_at(ring, -1), F.lit(False)), "not closed")
        .when(~F.coalesce(inside, F.lit(False)), "outside the globe")
    )


def looked_up(table: dict[str, str], key: Column) -> Column:
    """Value of a key in a small literal map; NULL for keys that it does not have."""
    return F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), lambda k, _: k == key)), F.lit(0))


def known_metrics(metrics: Column) -> Column:
    """A map of metrics without the names whose value is NULL."""
    return F.map_filter(metrics, lambda _, v: v.isNotNull())


#: Fields of a transition record, each with the names that it may come under, the first that is there.
TRANSITION_ALIASES = {
    "target_state": ("target_state", "target_severity"),
    "window_hours": ("window_hours", "window.hours"),
    "probability": ("probability",),
    "model_id": ("model_id",),
}


def transition_from_json(text: Column) -> Column:
    """Struct (target_state, window_hours, probability, model_id) from JSON; NULL for text that is none."""
    first = lambda names: F.coalesce(*[F.get_json_object(text, f"$.{n}") for n in names])
    got = {k: first(v) for k, v in TRANSITION_ALIASES.items()}
    made = F.struct(
        got["target_state"].alias("target_state"), got["window_hours"].cast("double").alias("window_hours"),
        got["probability"].cast("double").alias("probability"), got["model_id"].alias("model_id"),
    )
    return F.when(F.coalesce(*got.values()).isNotNull(), made)
