"""Tracks of streamed boxes in event time, and sessions of tracked points as a cross-check.

Boxes wait in the state of their event until the watermark has passed their frame. Frames are then taken in
the order of their times, whatever the order of their arrival: frames that come late (but not later than the
watermark allows), and frames whose boxes come in several batches, give the ids of a walk over the whole.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.tracks import BOX, step_tracks
from ..session import ship_package

BOXES = ("label_id", "centroid_lat", "centroid_lon", *BOX, "peak_zscore")
TRACKED = "event string, at long, label_id long, centroid_lat double, centroid_lon double, threat_id string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FrameWalker(StatefulProcessor):
    """State of an event: the boxes of each open frame, the open tracks, the next number, the last frame taken.

    Every frame sets a timer at its time. When timers expire, all frames up to there are walked. An event
    without a frame for ``idle_ms`` is over, and its state goes.
    """

    def __init__(self, gates: tuple, idle_ms: int | None):
        self.gates, self.idle_ms = gates, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "at long", "boxes string")
        self.walk = handle.getValueState("walk", "tracks string, next_id long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[dict]] = {}
        for pdf in rows:
            for row in pdf.to_dict("records"):
                boxes = fresh.setdefault(int(row["at"]), [])
                if pd.notna(row["label_id"]):  # a row without a label says that there is a frame, and no more
                    boxes.append({c: None if pd.isna(row[c]) else row[c] for c in BOXES})
        for at, boxes in fresh.items():
            if self.frames.containsKey((at,)):
                boxes = json.loads(self.frames.getValue((at,))[0]) + boxes
            else:
                self.handle.registerTimer(at)
            self.frames.updateValue((at,), (json.dumps(boxes),))
        yield pd.DataFrame(columns=[c.split()[0] for c in TRACKED.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        tracks, next_id, last = [], 1, None
        if self.walk.exists():
            held, next_id, last = self.walk.get()
            tracks = json.loads(held)
        out = []
        due = sorted(t for (t,) in self.frames.keys() if t <= now)
        for at in due:
            boxes = sorted(json.loads(self.frames.getValue((at,))[0]), key=lambda b: b["label_id"])
            year = dt.datetime.fromtimestamp(at / 1000, dt.timezone.utc).year
            tracks, ids, next_id = step_tracks(tracks, boxes, next_id, year, *self.gates)
            out += [(key[0], at, int(b["label_id"]), b["centroid_lat"], b["centroid_lon"], i) for b, i in zip(boxes, ids, strict=True)]
            self.frames.removeKey((at,))
            last = at
        if due:
            self.walk.update((json.dumps(tracks), next_id, last))
            if self.idle_ms is not None:
                self.handle.registerTimer(last + self.idle_ms)
        elif self.idle_ms is not None and last is not None and last + self.idle_ms <= now and not any(True for _ in self.frames.keys()):
            self.walk.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRACKED.split(", ")])

    def close(self) -> None:
        pass


def streamed_tracks(
    boxes: DataFrame, max_km: float | None = None, max_gap: int | None = None, late: str = "1 hour", min_iou: float | None = None, max_dz: float | None = None, idle: float | None = None
) -> DataFrame:
    """Ids for streamed boxes: event, valid_time, label_id, centroid_lat, centroid_lon, threat_id.

    ``boxes`` has event, valid_time, label_id, centroid_lat, centroid_lon and, for gates on them, the edges and
    peak_zscore. A frame without boxes is announced by a row without a label; without one it is no frame
    and no miss. Rows more than ``late`` behind the newest are dropped. With ``idle`` (hours) an event that has
    had no frame for so long is forgotten: if it comes back, its numbers start anew.
    """
    spark = boxes.sparkSession
    ship_package(spark)
    if "RocksDB" not in (spark.conf.get(_PROVIDER, "") or ""):
        spark.conf.set(_PROVIDER, _ROCKS)  # the only store with timers and keyed state
    have = {c.lower() for c in boxes.columns}
    marked = boxes.withWatermark("valid_time", late)
    rows = marked.select("event", "valid_time", F.unix_millis("valid_time").alias("at"), *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in BOXES])
    walker = FrameWalker((max_km, max_gap, min_iou, max_dz), None if idle is None else int(idle * 3_600_000))
    walked = rows.groupBy("event").transformWithStateInPandas(walker, TRACKED, "Append", "EventTime")
    return walked.select("event", F.timestamp_millis("at").alias("valid_time"), "label_id", "centroid_lat", "centroid_lon", "threat_id")


def track_sessions(points: DataFrame, gap: str | Column, key: str = "threat_id", late: str | None = None) -> DataFrame:
    """Sessions of tracked points: key, first, last and points of every stretch without a pause of ``gap``.

    A track that coasts over missed frames stays one session while its misses are shorter than the gap, so with
    a gap above (allowed misses + 1) frames there are as many sessions as tracks. On a stream ``late`` sets
    the watermark; valid_time must then be a timestamp.
    """
    rows = points.withWatermark("valid_time", late) if late else points
    grouped = rows.groupBy(*[c for c in ("event",) if c in points.columns], key, F.session_window("valid_time", gap).alias("w"))
    made = grouped.agg(F.min("valid_time").alias("first"), F.max("valid_time").alias("last"), F.count(F.lit(1)).alias("points"))
    return made.drop("w")

