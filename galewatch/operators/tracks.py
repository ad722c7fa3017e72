"""From boxes in frames to tracks with ids: gating, one-to-one assignment, steps, scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bearing_deg, box_iou, haversine_km
from ..sources.scratch import kept
from .scans import Axis, long_blocks, numbered, running_sum, with_neighbour


def steps(points: DataFrame, *group: str, block: Column | None = None) -> DataFrame:
    """Distance, course and speed from each point to the next of its track; the last point has no step.

    Without a group all points are one track. Points are scanned by blocks of time (months, unless ``block``
    names others), with the first point of the next block carried over.
    """
    made = with_neighbour(points, Axis(("valid_time",), group, block), "_next", "valid_time", "centroid_lat", "centroid_lon")
    here = (F.col("centroid_lat"), F.col("centroid_lon"), F.col("_next.centroid_lat"), F.col("_next.centroid_lon"))
    hours = (F.unix_seconds(F.col("_next.valid_time").cast("timestamp")) - F.unix_seconds(F.col("valid_time").cast("timestamp"))) / 3600.0
    return made.where("_next is not null").withColumns({"distance_km": haversine_km(*here), "bearing_deg": bearing_deg(*here), "hours": hours}).withColumn(
        "speed_kmh", F.when(F.col("hours") > 0, F.col("distance_km") / F.col("hours"))
    ).drop("_next")


def gated_pairs(boxes: DataFrame, frames: DataFrame, max_km: float | None, min_iou: float | None, max_dz: float | None) -> DataFrame:
    """Pairs of boxes of consecutive frames that pass every gate that has a threshold; cost in km."""
    order = numbered(frames.select("valid_time"), Axis(("valid_time",)), "k")
    side = lambda p: boxes.join(order, "valid_time").select(
        "k", *[F.col(c).alias(p + c) for c in ("label_id", "lat_min", "lat_max", "lon_min", "lon_max", "centroid_lat", "centroid_lon", "peak_zscore", "valid_time")]
    )
    a, b = side("a_"), side("b_").withColumn("k", F.col("k") - 1)
    both = a.join(b, "k").withColumn("cost_km", haversine_km(F.col("a_centroid_lat"), F.col("a_centroid_lon"), F.col("b_centroid_lat"), F.col("b_centroid_lon")))
    corner = lambda p: {k: F.col(p + c) for k, c in (("s", "lat_min"), ("n", "lat_max"), ("w", "lon_min"), ("e", "lon_max"))}
    both = both.withColumn("iou", box_iou(corner("a_"), corner("b_"))).withColumn("dz", F.abs(F.col("a_peak_zscore") - F.col("b_peak_zscore")))
    gates: list[Column] = [F.col("cost_km") <= max_km] if max_km is not None else []
    gates += [F.col("iou") >= min_iou] if min_iou is not None else []
    gates += [F.col("dz") <= max_dz] if max_dz is not None else []
    for g in gates:
        both = both.where(g)
    return both


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of least total cost; infinite entries are forbidden.

    Rows and columns without a finite entry are left out. If the rest has no complete matching,
    pairs are taken greedily by cost, then row, then column.
    """
    rows, cols = np.flatnonzero(np.isfinite(cost).any(1)), np.flatnonzero(np.isfinite(cost).any(0))
    if not len(rows):
        return []
    sub = cost[np.ix_(rows, cols)]
    flip = sub.shape[0] > sub.shape[1]
    c = sub.T if flip else sub
    big = 1e12
    c = np.where(np.isfinite(c), c, big)
    n, m = c.shape
    # shortest augmenting paths with potentials (the Hungarian method), rows one by one
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        dist, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            cur = c[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = cur < dist[free]
            dist[free[better]], way[free[better]] = cur[better], j0
            j1 = free[np.argmin(dist[free])]
            delta = dist[j1]
            u[match[used]] += delta
            v[used] -= delta
            dist[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    if any(c[p] >= big for p in pairs):
        taken, pairs = (set(), set()), []
        for _, r, k in sorted((c[r, k], r, k) for r in range(n) for k in range(m) if c[r, k] < big):
            if r not in taken[0] and k not in taken[1]:
                taken[0].add(r)
                taken[1].add(k)
                pairs.append((r, k))
    pairs = [(k, r) for r, k in pairs] if flip else pairs
    return sorted((int(rows[r]), int(cols[k])) for r, k in pairs)


def _km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, q = np.radians(a)[:, None, :], np.radians(b)[None, :, :]
    h = np.sin((q - p)[..., 0] / 2) ** 2 + np.cos(p[..., 0]) * np.cos(q[..., 0]) * np.sin((q - p)[..., 1] / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def _iou(a: list[dict], b: list[dict]) -> np.ndarray:
    """Overlap of every box of one list with every box of the other; 0 where the union has no area."""
    side = lambda rows, c: np.array([r[c] if r.get(c) is not None else np.nan for r in rows], float)
    (s1, n1, w1, e1), (s2, n2, w2, e2) = ([side(rows, c) for c in BOX] for rows in (a, b))
    high = np.maximum(np.minimum(n1[:, None], n2) - np.maximum(s1[:, None], s2), 0)
    wide = np.maximum(np.minimum(e1[:, None], e2) - np.maximum(w1[:, None], w2), 0)
    union = ((n1 - s1) * (e1 - w1))[:, None] + (n2 - s2) * (e2 - w2) - high * wide
    return np.where(union > 0, high * wide / np.where(union > 0, union, 1), np.where(np.isnan(union), np.nan, 0.0))


#: Edges of a box: south, north, west, east.
BOX = ("lat_min", "lat_max", "lon_min", "lon_max")


def step_tracks(
    state: list[dict], boxes: list[dict], next_id: int, year: int, max_km: float | None, max_gap: int | None, min_iou: float | None = None, max_dz: float | None = None
) -> tuple[list[dict], list[str], int]:
    """One frame: open tracks after it, the id of each box, and the next number.

    A pair is possible when it passes every gate that has a threshold: distance, overlap of the boxes and
    difference of the peaks; a box or peak that is missing fails its gate. Costs are distances.
    """
    ids: list[str | None] = [None] * len(boxes)
    if state and boxes:
        cost = _km(np.array([[t["lat"], t["lon"]] for t in state]), np.array([[b["centroid_lat"], b["centroid_lon"]] for b in boxes]))
        cost = np.where(cost > max_km, np.inf, cost) if max_km is not None else cost
        if min_iou is not None:
            cost = np.where(_iou(state, boxes) >= min_iou, cost, np.inf)
        if max_dz is not None:
            peak = lambda rows: np.array([r["peak_zscore"] if r.get("peak_zscore") is not None else np.nan for r in rows], float)
            cost = np.where(np.abs(peak(state)[:, None] - peak(boxes)) <= max_dz, cost, np.inf)
        hits = assign(cost)
    else:
        hits = []
    opened = lambda i, b: {"id": i, "lat": b["centroid_lat"], "lon": b["centroid_lon"], "missed": 0} | {c: b.get(c) for c in (*BOX, "peak_zscore")}
    hit = dict(hits)
    going = []
    for i, t in enumerate(state):
        if i in hit:
            ids[hit[i]] = t["id"]
            going.append(opened(t["id"], boxes[hit[i]]))
        elif max_gap is not None and t["missed"] + 1 <= max_gap:
            going.append(t | {"missed": t["missed"] + 1})
    for k, b in enumerate(boxes):
        if ids[k] is None:
            ids[k] = f"THR-{year:04d}-{next_id:04d}"
            next_id += 1
            going.append(opened(ids[k], b))
    return going, ids, next_id


def reached_frames(boxes: DataFrame, frames: DataFrame, max_km: float | None, max_gap: int | None, min_iou: float | None, max_dz: float | None, event: str = "event") -> DataFrame:
    """(event, k) of the frames that a track may enter from an earlier one.

    A track joins boxes at most ``max_gap`` missed frames apart that pass all gates. Where no such pair
    crosses the border between two frames, no track does, and the walk may start anew. The gates are a
    little wider here than in the walk, so that rounding never hides a pair. ``frames`` has k, without gaps.
    """
    reach = (max_gap or 0) + 1
    have = [c for c in (*BOX, "peak_zscore") if c in boxes.columns]
    side = lambda p: boxes.join(frames.select(event, "valid_time", "k"), [event, "valid_time"]).select(event, "k", *[F.col(c).alias(p + c) for c in ("centroid_lat", "centroid_lon", *have)])
    a = side("a_").select("*", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("d")).withColumn("start", F.col("k")).withColumn("k", F.col("k") + F.col("d"))
    both = a.join(side("b_"), [event, "k"])
    if max_km is not None:
        both = both.where(haversine_km(F.col("a_centroid_lat"), F.col("a_centroid_lon"), F.col("b_centroid_lat"), F.col("b_centroid_lon")) <= max_km * (1 + 1e-9) + 1e-6)
    if min_iou is not None:
        corner = lambda p: {k: F.col(p + c) for k, c in (("s", "lat_min"), ("n", "lat_max"), ("w", "lon_min"), ("e", "lon_max"))}
        both = both.where(box_iou(corner("a_"), corner("b_")) >= min_iou - 1e-9) if set(BOX) <= set(have) else both.where("false")
    if max_dz is not None:
        both = both.where(F.abs(F.col("a_peak_zscore") - F.col("b_peak_zscore")) <= max_dz + 1e-9) if "peak_zscore" in have else both.where("false")
    return both.select(event, F.explode(F.sequence(F.col("start") + 1, F.col("k"))).alias("k")).distinct()


def segments(boxes: DataFrame, frames: DataFrame, max_km: float | None = None, max_gap: int | None = None, event: str = "event", min_iou: float | None = None, max_dz: float | None = None) -> DataFrame:
    """Frames (event, valid_time) with k, their place in the event, and segment: no track goes from one segment to the next."""
    axis = Axis(("valid_time",), (event,))
    placed = numbered(frames.select(event, "valid_time").distinct(), axis, "k")
    reached = reached_frames(boxes, placed, max_km, max_gap, min_iou, max_dz, event).withColumn("_in", F.lit(1))
    marked = placed.join(reached, [event, "k"], "left")
    return running_sum(marked, axis, F.col("_in").isNull().cast("long"), "segment").drop("_in")


def track(
    boxes: DataFrame, frames: DataFrame, max_km: float | None = None, max_gap: int | None = None, event: str = "event", min_iou: float | None = None, max_dz: float | None = None
) -> DataFrame:
    """Persistent ids for the boxes of every event, numbered in the order in which tracks begin.

    Frames without boxes count as misses. A NULL gap limit ends a track at its first miss; a gate without
    a threshold is open. The frames of an event are cut into segments that no track crosses; a task walks
    one segment, and the tracks begun in earlier segments are added to its numbers afterwards, so that
    ids are those of one walk over the whole event. Rows with a null event or time are left out.
    """
    extra = [c for c in (*BOX, "peak_zscore") if c in boxes.columns]
    placed = kept(segments(boxes, frames, max_km, max_gap, event, min_iou, max_dz))
    rows = placed.join(boxes, [event, "valid_time"], "left")
    schema = f"{event} string, segment long, valid_time timestamp_ntz, label_id long, centroid_lat double, centroid_lon double, year int, number long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, n, out = [], 1, []
        head = (pdf[event].iloc[0], int(pdf["segment"].iloc[0]))
        for t, g in pdf.sort_values(["valid_time", "label_id"]).groupby("valid_time", sort=True):
            seen = g[g["label_id"].notna()].to_dict("records")
            state, ids, n = step_tracks(state, seen, n, t.year, max_km, max_gap, min_iou, max_dz)
            parts = [i.split("-") for i in ids]
            out += [(*head, t, int(b["label_id"]), b["centroid_lat"], b["centroid_lon"], int(y), int(k)) for b, (_, y, k) in zip(seen, parts, strict=True)]
        return pd.DataFrame(out, columns=[event, "segment", "valid_time", "label_id", "centroid_lat", "centroid_lon", "year", "number"])

    walked = kept(rows.select(event, "segment", "valid_time", "label_id", "centroid_lat", "centroid_lon", *extra).groupBy(event, "segment").applyInPandas(run, schema))
    made = walked.groupBy(event, "segment").agg(F.max("number").alias("made"))
    ahead = running_sum(made, Axis(("segment",), (event,), long_blocks("segment")), F.col("made"), "ahead", before=True).select(event, "segment", "ahead")
    threat_id = F.format_string("THR-%04d-%04d", "year", F.col("number") + F.col("ahead"))
    return walked.join(ahead, [event, "segment"]).select(event, "valid_time", "label_id", "centroid_lat", "centroid_lon", threat_id.alias("threat_id"))


def trajectories(tracked: DataFrame) -> DataFrame:
    """Tracks as nested histories: event (if there is one) and threat_id, first and last time, steps in time order."""
    step = F.struct("valid_time", F.array("centroid_lat", "centroid_lon").alias("centroid"))
    return tracked.groupBy(*[c for c in ("event",) if c in tracked.columns], "threat_id").agg(F.array_sort(F.collect_list(step)).alias("historical_steps"), F.min("valid_time").alias("first"), F.max("valid_time").alias("last"), F.count(F.lit(1)).alias("n"))


def matched_steps(reference: DataFrame, predicted: DataFrame, radius_km: float) -> DataFrame:
    """For every reference point the nearest predicted one of its time, if within the radius."""
    p = predicted.select("valid_time", F.col("threat_id").alias("p_id"), F.col("centroid_lat").alias("p_lat"), F.col("centroid_lon").alias("p_lon"))
    both = reference.join(p, "valid_time", "left").withColumn("km", haversine_km(F.col("centroid_lat"), F.col("centroid_lon"), F.col("p_lat"), F.col("p_lon")))
    best = F.min_by(F.struct("km", "p_id"), F.struct("km", "p_id")).alias("best")
    got = both.groupBy("threat_id", "valid_time").agg(best)
    near = F.col("best.km") <= radius_km
    return got.select("threat_id", "valid_time", F.when(near, F.col("best.km")).alias("km"), F.when(near, F.col("best.p_id")).alias("p_id"))


def _hours(points: DataFrame, key: str) -> DataFrame:
    """(key, hours, points) from the first to the last point of each track."""
    at = F.unix_seconds(F.col("valid_time").cast("timestamp"))
    return points.groupBy(key).agg(((F.max(at) - F.min(at)) / 3600.0).alias("hours"), F.count(F.lit(1)).alias("points"))


def tracking_scores(matched: DataFrame, reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """Mean and root-mean-square error, share of covered points, share of covered tracks with one id, and the
    mean difference of durations over those of them that have two points or more on both sides."""
    per = matched.groupBy("threat_id").agg(F.countDistinct("p_id").alias("ids"), F.count("p_id").alias("hits"), F.max("p_id").alias("p_id"))
    ids = per.agg(F.try_divide(F.sum((F.col("ids") == 1).cast("double")), F.sum((F.col("hits") > 0).cast("double"))).alias("id_consistency"))
    r = _hours(reference, "threat_id").where("points >= 2")
    p = _hours(predicted.withColumnRenamed("threat_id", "p_id"), "p_id").where("points >= 2").select("p_id", F.col("hours").alias("p_hours"))
    durations = per.where("ids = 1").join(r, "threat_id").join(p, "p_id").agg(F.avg(F.abs(F.col("hours") - F.col("p_hours"))).alias("duration_error_hours"))
    all_ = matched.agg(F.avg("km").alias("mean_km"), F.sqrt(F.avg(F.col("km") * F.col("km"))).alias("rms_km"), F.avg(F.col("p_id").isNotNull().cast("double")).alias("continuity"))
    return all_.join(ids).join(durations)  # one row each
