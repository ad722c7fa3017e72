"""Bringing fields together: names, units, time slices, exact lookups, pairs in step, hold-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contracts import ContractError

#: Short names that variables may also come under.
SHORT_NAMES = {"mean_sea_level_pressure": "msl", "2m_temperature": "t2m", "total_precipitation": "tp", "10m_u_component_of_wind": "u10", "10m_v_component_of_wind": "v10"}
#: value * scale + offset, and the unit that comes of it.
UNITS = {"msl": (0.01, 0.0, "hPa"), "t2m": (1.0, -273.15, "degC"), "tp": (1000.0, 0.0, "mm")}
KEY_DECIMALS = 8


def variable_column(df: DataFrame, name: str) -> str:
    """Column of a variable by its long or its short name; ValueError if the table has neither."""
    for c in (name, SHORT_NAMES.get(name)):
        if c and c in df.columns:
            return c
    raise ValueError(f"no variable {name!r} among {', '.join(df.columns)}")


def canonical_time(df: DataFrame, name: str = "time") -> DataFrame:
    """The time axis under one name, whichever of valid_time and time it has."""
    return df.withColumnRenamed("valid_time", name) if "valid_time" in df.columns and name not in df.columns else df


def in_display_units(variable: Column, value: Column) -> Column:
    """The value in the unit that people read; of other variables, as it is."""
    made = value
    for name, (scale, offset, _) in UNITS.items():
        made = F.when(variable == name, value * scale + offset).otherwise(made)
    return made


def unit_of(variable: Column) -> Column:
    return F.coalesce(*[F.when(variable == n, F.lit(u)) for n, (_, _, u) in UNITS.items()], F.lit(None).cast("string"))


def time_slice(cells: DataFrame, at: Column, extra: list[str], cell: list[str], time: str = "valid_time") -> DataFrame:
    """Cells of one time; of any further dimension only its first coordinate in each cell."""
    w = Window.partitionBy(*cell).orderBy(*extra)
    return cells.where(F.col(time) == at).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def coordinate_key(x: Column) -> Column:
    """A coordinate as a whole number of its eighth decimal, so that equal ones join."""
    return F.round(x * 10**KEY_DECIMALS).cast("long")


def exact_lookup(wanted: DataFrame, source: DataFrame, coords: tuple[str, ...] = ("latitude", "longitude"), strict: bool = True) -> DataFrame:
    """Rows of ``wanted`` with those of ``source`` at the same coordinates; ContractError if one has none."""
    keys = [f"_{c}" for c in coords]
    a = wanted.withColumns({k: coordinate_key(F.col(c)) for k, c in zip(keys, coords, strict=True)})
    b = source.withColumns({k: coordinate_key(F.col(c)) for k, c in zip(keys, coords, strict=True)}).drop(*coords)
    if strict:
        lost = a.join(b, keys, "left_anti").select(*coords).limit(5).collect()
        if lost:
            raise ContractError("no source cell at " + ", ".join(str(tuple(r)) for r in lost))
    return a.join(b, keys).drop(*keys)


def enrich(rows: DataFrame, lookup: DataFrame, *key: str) -> DataFrame:
    """Columns of a lookup table beside every row; NULL where it has no such key."""
    return rows.join(lookup, list(key), "left")


def in_step(coarse: DataFrame, fine: DataFrame, time: str = "valid_time", by: str | None = None) -> DataFrame:
    """(position, coarse_time, fine_time) of two time axes side by side, as far as the shorter one goes.

    ``by`` names a key of series; without it each table is one series, an axis of one row a frame.
    """
    keys = [by] if by else []

    def numbered(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(time) if keys else Window.orderBy(time)
        return df.select(*keys, time).distinct().select(*keys, F.row_number().over(w).alias("position"), F.col(time).alias(name))

    return numbered(coarse, "coarse_time").join(numbered(fine, "fine_time"), [*keys, "position"])


def aligned(coarse: DataFrame, fine: DataFrame, time: str = "valid_time") -> DataFrame:
    """``in_step``; ContractError where the times at one position differ."""
    pairs = in_step(coarse, fine, time)
    bad = pairs.where("coarse_time <> fine_time").limit(1).collect()
    if bad:
        raise ContractError(f"step {bad[0]['position']}: {bad[0]['coarse_time']} against {bad[0]['fine_time']}")
    return pairs


def within_footprint(pairs: DataFrame, prediction: str = "p", reference: str = "r") -> DataFrame:
    """The prediction only where the reference has a value."""
    return pairs.withColumn(prediction, F.when(F.col(reference).isNotNull(), F.col(prediction)))


def axis_split(axis: DataFrame, coord: str, share: float = 0.85) -> DataFrame:
    """(coord, part) of an axis cut by position: the first ``round(share * n)``, at least one, train; the
    rest validates. Where that leaves nothing to validate on, all coordinates do both."""
    places = axis.select(coord).distinct()
    n = places.agg(F.count(F.lit(1)).alias("n"))
    at = places.select(coord, F.row_number().over(Window.orderBy(coord)).alias("k")).join(F.broadcast(n))  # one row
    cut = F.greatest(F.lit(1), F.bround(F.col("n") * share).cast("int"))
    parts = F.when(cut >= F.col("n"), F.array(F.lit("train"), F.lit("validate"))).when(F.col("k") <= cut, F.array(F.lit("train"))).otherwise(F.array(F.lit("validate")))
    return at.select(coord, F.explode(parts).alias("part"))


def hold_out(field: DataFrame, coord: str, share: float) -> DataFrame:
    """Add held_out: cells at or beyond the (1 - share) quantile of the distinct coordinates; ContractError
    if either side is empty."""
    cut = field.select(coord).distinct().agg(F.percentile(coord, F.lit(1 - share)).alias("cut"), F.min(coord).alias("low"), F.max(coord).alias("high"))
    got = cut.first()
    if got["cut"] is None or got["low"] >= got["cut"] or got["high"] < got["cut"]:
        raise ContractError(f"a hold-out of {share} leaves one side of {coord} empty")
    return field.withColumn("held_out", F.col(coord) >= F.lit(got["cut"]))


def before_pilot(rows: DataFrame, start: str, step: str = "INTERVAL 1 HOUR", time: str = "valid_time") -> DataFrame:
    """Rows before ``start``; ContractError unless the last of them is exactly one step before it."""
    kept = rows.where(F.col(time) < F.expr(f"TIMESTAMP_NTZ '{start}'"))
    ends = kept.agg(F.max(time).alias("last"), F.expr(f"TIMESTAMP_NTZ '{start}' - {step}").alias("wanted")).first()
    if ends["last"] != ends["wanted"]:
        raise ContractError(f"training ends at {ends['last']}, not at {ends['wanted']}")
    return kept


def region_files(listing: DataFrame, region: str, legacy_region: str) -> DataFrame:
    """Files of a region (path, region; NULL region for old names without one). Old files serve
    ``legacy_region`` only, and only where it has no file of its own."""
    own = listing.where(F.col("region") == region)
    if region != legacy_region:
        return own
    some = own.agg((F.count(F.lit(1)) > 0).alias("some"))
    old = listing.where("region is null").join(F.broadcast(some), ~F.col("some")).drop("some")  # one row
    return own.unionByName(old)


def grid_mean_series(cells: DataFrame, time: str = "valid_time") -> DataFrame:
    """Mean of all cells for each frame."""
    return cells.groupBy(time).agg(F.avg("value").alias("mean"))


def axis_resolution(cells: DataFrame, coord: str = "latitude") -> DataFrame:
    """Median step of an axis in degrees, and in kilometres along a meridian; NULL for a single coordinate."""
    w = Window.orderBy(coord)  # an axis
    gaps = cells.select(coord).distinct().select((F.col(coord) - F.lag(coord).over(w)).alias("gap"))
    step = F.percentile("gap", F.lit(0.5))
    return gaps.agg(step.alias("step"), (step * 111.32).alias("km"))


def bump(distance: Column, amplitude: Column, core: Column, radius: Column) -> Column:
    """A peak that is flat inside its core and falls off as a Gaussian of ``radius`` outside."""
    out = F.greatest(distance - core, F.lit(0.0)) / radius
    return amplitude * F.exp(-0.5 * out * out)


def peak_frame(cells: DataFrame, direction: str = "high", time: str = "valid_time") -> DataFrame:
    """The frame with the highest (or, with "low", lowest) value and that value; the first of equal ones."""
    if direction not in ("high", "low"):
        raise ValueError(direction)
    per = cells.groupBy(time).agg((F.max if direction == "high" else F.min)("value").alias("peak"))
    size = F.col("peak") if direction == "high" else -F.col("peak")
    best = per.where("peak is not null").agg(F.max_by(F.struct(time, "peak"), F.struct(size, -F.unix_seconds(F.col(time).cast("timestamp")))).alias("b"))
    return best.select(f"b.{time}", "b.peak")
