"""Scans by blocks and tracks by segments against one walk over everything."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from galewatch import catalog
from galewatch.operators import scans, tracks

T0 = dt.datetime(2020, 1, 20)
BOXES = "event string, valid_time timestamp_ntz, label_id long, centroid_lat double, centroid_lon double, lat_min double, lat_max double, lon_min double, lon_max double, peak_zscore double"


def one_walk(rows, frames, *gates):
    """Ids from a single walk over the frames of each event."""
    out = {}
    for event in {e for e, _ in frames}:
        state, n = [], 1
        for t in sorted(t for e, t in frames if e == event):
            seen = sorted((r for r in rows if r["event"] == event and r["valid_time"] == t), key=lambda r: r["label_id"])
            state, ids, n = tracks.step_tracks(state, seen, n, t.year, *gates)
            out |= {(event, t, r["label_id"]): i for r, i in zip(seen, ids, strict=True)}
    return out


def walk_of_boxes(seed, frames=120, events=("a", "b")):
    rng = random.Random(seed)
    rows, times = [], []
    for e in events:
        at = [(10.0 + 3 * k, 70.0 + 4 * k) for k in range(3)]
        for k in range(frames):
            t = T0 + dt.timedelta(hours=6 * k)
            times.append((e, t))
            at = [(y + rng.uniform(-0.5, 0.5), x + rng.uniform(-0.5, 0.5)) if rng.random() < 0.95 else (rng.uniform(0, 30), rng.uniform(60, 90)) for y, x in at]
            for label, (y, x) in enumerate(at, 1):
                if rng.random() < (0.05 if k % 20 > 15 else 0.8):
                    peak = rng.choice([None, rng.uniform(1, 4)])
                    rows.append(dict(zip(BOXES.replace(" ", ",").split(",")[::3], (e, t, label, y, x, y - 1, y + 1, x - 1, x + 1, peak), strict=True)))
    return rows, times


@pytest.mark.parametrize("gates", [(100.0, 2, None, None), (150.0, None, None, None), (400.0, 1, 0.1, 1.5), (None, 3, 0.0, None), (60.0, 0, None, 2.0)])
def test_segments_give_the_ids_of_one_walk(spark, gates):
    rows, times = walk_of_boxes(7)
    boxes, frames = spark.createDataFrame([tuple(r.values()) for r in rows], BOXES), spark.createDataFrame(times, "event string, valid_time timestamp_ntz")
    km, gap, iou, dz = gates
    got = tracks.track(boxes, frames, km, gap, min_iou=iou, max_dz=dz).collect()
    assert {(r.event, r.valid_time, r.label_id): r.threat_id for r in got} == one_walk(rows, times, *gates) and len(got) == len(rows)
    cut = {(r.event, r.segment) for r in tracks.segments(boxes, frames, km, gap, "event", iou, dz).collect()}
    assert len(cut) > 2 or km is None


def test_without_any_box_or_frame(spark):
    boxes, frames = spark.createDataFrame([], BOXES), spark.createDataFrame([("a", T0)], "event string, valid_time timestamp_ntz")
    assert tracks.track(boxes, frames, 100.0, 1).count() == 0 and tracks.track(boxes, frames.limit(0), 100.0, 1).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_registered_tracks_are_those_of_one_walk(spark, sf):
    d = f"/root/testdata/sf{sf}"
    from galewatch.plans import detection

    boxes = [r.asDict() | {"event": "all"} for r in detection._boxes(spark, d).collect()]
    frames = [("all", r.valid_time) for r in detection._obs(spark, d).select("valid_time").distinct().collect()]
    got = catalog.queries()["track_assign"](spark, d).collect()
    want = one_walk(boxes, frames, 400.0, 1, 0.0, 1.5)
    assert {(r.event, r.valid_time, r.label_id): r.threat_id for r in got} == want and len(got) == len(want) > 0
    whole = catalog.queries()["trajectories"](spark, d).collect()
    assert len(whole) == len(set(want.values())) and sum(r.n for r in whole) == len(want)
    for r in whole:
        times = [s.valid_time for s in r.historical_steps]
        assert times == sorted(times) and (r["first"], r["last"]) == (times[0], times[-1])


def test_registered_stream_gives_the_ids_of_the_table(spark):
    got, want = (sorted(map(tuple, catalog.queries()[n](spark, "/root/testdata/sf0.001").collect())) for n in ("streamed_track_ids", "track_assign"))
    assert got == want and got


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(4)
    at = [T0 + dt.timedelta(hours=h) for h in sorted(rng.sample(range(24 * 200), 300))]
    rows = [(rng.choice(["x", "y", None]), t, rng.choice([None, 1, 2, 5])) for t in at]
    return rows, spark.createDataFrame(rows, "g string, valid_time timestamp_ntz, v long")


@pytest.mark.parametrize("group", [(), ("g",)])
def test_scans_across_blocks(points, group):
    rows, table = points
    axis = scans.Axis(("valid_time",), group)
    made = scans.with_neighbour(table, axis, "next", "valid_time", "v")
    made = scans.with_neighbour(made, axis, "last", "v", ahead=False)
    made = scans.numbered(scans.running_sum(scans.running_sum(made, axis, F.col("v"), "s"), axis, F.col("v"), "b", before=True), axis, "k")
    got = {r.valid_time: r for r in made.collect()}
    for g in {r[0] for r in rows} if group else {None}:
        own = [r for r in rows if not group or r[0] == g]
        for k, r in enumerate(own):
            have = got[r[1]]
            assert (tuple(have.next) if have.next else None) == (own[k + 1][1:] if k + 1 < len(own) else None)
            assert (tuple(have.last) if have.last else None) == ((own[k - 1][2],) if k else None)
            before = sum(x[2] or 0 for x in own[:k])
            assert (have.k, have.b, have.s) == (k + 1, before, before + (r[2] or 0))


def test_steps_have_no_window_over_all_frames(spark):
    for name in ("haversine_steps", "bearing_steps", "speed_steps", "relocation_events"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        single = [k for k, line in enumerate(lines) if "Exchange SinglePartition" in line]
        # what goes to one partition has a row a block: it comes out of an aggregate by block
        assert all("_block" in lines[k + 1] and "HashAggregate" in lines[k + 1] or "SortAggregate" in lines[k + 1] for k in single), plan
