"""Streamed tracks equal batch tracks, whatever the order in which rows arrive; frames, anomalies and sessions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from galewatch.operators import detect, tracks
from galewatch.streaming.frames import frame_means, streamed_anomalies
from galewatch.streaming.tracker import streamed_tracks, track_sessions

T0 = dt.datetime(2020, 5, 16)
SCHEMA = "event string, valid_time timestamp, label_id long, centroid_lat double, centroid_lon double, lat_min double, lat_max double, lon_min double, lon_max double, peak_zscore double"


def through(spark, folder, batches, schema, build, name):
    """Rows of a stream that reads one file a batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"all/{k}"))
        for f in (folder / f"all/{k}").glob("*.parquet"):
            (folder / "in").mkdir(exist_ok=True)
            f.rename(folder / "in" / f"{k:04d}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(folder / "ck")).start()
    q.awaitTermination(240)
    return spark.table(name).collect()


def box(event, k, label, y, x, peak=2.0):
    return (event, T0 + dt.timedelta(hours=k), label, y, x, y - 1, y + 1, x - 1, x + 1, peak)


def empty(event, k):
    return (event, T0 + dt.timedelta(hours=k), *[None] * 8)


GATES = [(100.0, 1, None, None), (400.0, 2, 0.2, 1.0), (150.0, None, None, None)]


@pytest.mark.parametrize("gates", GATES)
def test_late_split_and_empty_frames_give_the_ids_of_a_batch(spark, tmp_path, gates):
    rng = random.Random(9)
    rows = []
    for event in ("a", "b"):
        at = [(10.0, 70.0), (16.0, 76.0)]
        for k in range(24):
            at = [(y + rng.uniform(-0.4, 0.4), x + rng.uniform(-0.4, 0.4)) for y, x in at]
            seen = [box(event, k, label, y, x, rng.uniform(1, 3)) for label, (y, x) in enumerate(at, 1) if rng.random() < 0.75]
            rows += [(k, r) for r in seen] or [(k, empty(event, k))]
    # every row comes up to two hours late, so frames come in pieces and in a wrong order
    arriving = sorted(rows, key=lambda r: r[0] + rng.randrange(3))
    batches = [[r for _, r in arriving[i : i + 12]] for i in range(0, len(arriving), 12)] + [[empty("a", 400)], [empty("z", 401)]]
    km, gap, iou, dz = gates
    got = through(spark, tmp_path, batches, SCHEMA, lambda s: streamed_tracks(s, km, gap, "6 hours", iou, dz), "walked")
    static = spark.createDataFrame([r for _, r in rows], SCHEMA.replace("timestamp", "timestamp_ntz"))
    batch = tracks.track(static.where("label_id is not null"), static.select("event", "valid_time").distinct(), km, gap, min_iou=iou, max_dz=dz).collect()
    flat = lambda rows: sorted((r.event, r.valid_time, r.label_id, r.threat_id) for r in rows)
    assert flat(got) == flat(batch) and len({r.threat_id for r in batch}) > 2


def test_rows_behind_the_watermark_go_and_idle_events_are_forgotten(spark, tmp_path):
    batches = [[box("a", 0, 1, 10.0, 70.0)], [box("a", 30, 1, 10.0, 70.0)], [empty("z", 60)], [empty("z", 61)], [box("a", 31, 2, 20.0, 90.0)], [box("a", 90, 1, 10.0, 70.0)], [empty("z", 200)], [empty("z", 300)]]
    got = through(spark, tmp_path, batches, SCHEMA, lambda s: streamed_tracks(s, 100.0, 1, "2 hours", idle=12.0), "forgotten")
    hours = sorted(((r.valid_time - T0).total_seconds() / 3600, r.label_id, r.threat_id) for r in got)
    # hour 31 came when the watermark of the batch before stood at 58; after 12 hours without a frame the numbers start anew
    assert hours == [(0, 1, "THR-2020-0001"), (30, 1, "THR-2020-0001"), (90, 1, "THR-2020-0001")]


def test_frame_means(spark, tmp_path):
    rows = [(T0, 1, 2.0), (T0 + dt.timedelta(minutes=5), 67, 4.0), (T0 + dt.timedelta(hours=9), 1, 9.0)]
    got = through(spark, tmp_path, [rows], "ts timestamp, user_id long, value double", frame_means, "means")
    assert [(r.node_id, r.value) for r in got] == [(1, 3.0)]


def test_streamed_anomalies_equal_batch(spark, tmp_path):
    schema = "valid_time timestamp, node_id long, lat_i long, lon_i long, value double"
    rows = [(T0 + dt.timedelta(hours=h), n, n // 6, n % 6, float((h * 7 + n) % 11)) for h in range(5) for n in range(12)]
    static = spark.createDataFrame(rows, schema)
    clim = detect.climatology(static, "node_id")
    got = through(spark, tmp_path, [rows[:30], rows[30:]], schema, lambda s: streamed_anomalies(s, clim.select("node_id", "mean", "std")), "anomalies")
    want = detect.anomalies(static, detect.climatology(static)).collect()
    assert sorted((r.valid_time, r.node_id, round(r.z, 9)) for r in got) == sorted((r.valid_time, r.node_id, round(r.z, 9)) for r in want)


def test_sessions_are_as_many_as_coasting_tracks(spark, tmp_path):
    """A track misses a frame and comes back; another ends, and one begins at its place after a long gap."""
    rows = [box("a", k, 1, 10.0 + k / 10, 70.0) for k in (0, 1, 3, 4)] + [box("a", k, 2, 30.0, 90.0) for k in (0, 1)] + [box("a", k, 2, 30.0, 90.0) for k in (8, 9)]
    frames = spark.createDataFrame([("a", T0 + dt.timedelta(hours=k)) for k in range(10)], "event string, valid_time timestamp_ntz")
    tracked = tracks.track(spark.createDataFrame(rows, SCHEMA.replace("timestamp", "timestamp_ntz")), frames, 100.0, 1)
    sessions = track_sessions(tracked, "3 hours").collect()
    assert len(sessions) == tracked.select("threat_id").distinct().count() == 3 and sorted(r.points for r in sessions) == [2, 2, 4]
    named = [(r.event, r.valid_time, r.threat_id) for r in tracked.collect()]
    last = [("z", T0 + dt.timedelta(hours=h), "THR-0") for h in (100, 200)]
    schema = "event string, valid_time timestamp, threat_id string"
    got = through(spark, tmp_path, [named[::2], named[1::2], last[:1], last[1:]], schema, lambda s: track_sessions(s, "3 hours", late="24 hours"), "sessions")
    flat = lambda rows: sorted((r.threat_id, r.first.replace(tzinfo=None), r.points) for r in rows if r.event == "a")
    assert flat(got) == flat(sessions)
    # with a gap of less than the allowed misses a coasting track falls apart
    assert track_sessions(tracked, "90 minutes").count() == 4


def test_session_key_of_points_without_an_event(spark):
    rows = [(T0 + dt.timedelta(hours=h), "t") for h in (0, 1, 5)]
    got = track_sessions(spark.createDataFrame(rows, "valid_time timestamp_ntz, threat_id string"), F.lit("2 hours")).collect()
    assert sorted(r.points for r in got) == [1, 2]
