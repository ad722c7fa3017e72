"""Known answers for the grid, track, series and metric operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from galewatch.operators import detect, escalation, grids, metrics, series, tracks
from galewatch.sources.tables import upsert

T0 = dt.datetime(2020, 5, 16)


def _hours(k):
    return T0 + dt.timedelta(hours=k)


def test_two_flagged_neighbours_are_one_region(spark):
    rows = [(T0, n, n // 6, n % 6, 10 + 0.5 * (n // 6), 76.0 + n % 6, 3.0) for n in (7, 8, 20)]
    flags = spark.createDataFrame(rows, "valid_time timestamp_ntz, node_id long, lat_i long, lon_i long, latitude double, longitude double, z double")
    boxes = detect.region_boxes(detect.label_regions(flags)).collect()
    assert [(b.cell_count, b.centroid_lat, b.centroid_lon, b.label_id) for b in boxes] == [(2, 10.5, 77.5, 1)]


def test_runs_label_like_tasks(spark, tmp_path):
    rng = np.random.default_rng(5)
    cells = [(T0, i * 12 + j, i, j, float(i), float(j), 1.0) for i in range(12) for j in range(12) if rng.random() < 0.55]
    flags = spark.createDataFrame(cells, "valid_time timestamp_ntz, node_id long, lat_i long, lon_i long, latitude double, longitude double, z double")
    one = {(r.node_id, r.label_id) for r in detect.label_regions(flags).collect()}
    other = {(r.node_id, r.label_id) for r in detect.label_runs(flags).collect()}
    assert one == other


def test_assignment_is_least_cost_and_falls_back_to_greedy():
    assert tracks.assign(np.array([[4.0, 1.0, 3.0], [2.0, 0.0, 5.0], [3.0, 2.0, 2.0]])) == [(0, 1), (1, 0), (2, 2)]
    inf = np.inf
    assert tracks.assign(np.array([[1.0, inf], [2.0, inf]])) == [(0, 0)]
    assert tracks.assign(np.array([[1.0, inf, 5.0], [2.0, inf, inf], [inf, inf, inf]])) == [(0, 2), (1, 0)]
    assert tracks.assign(np.array([[inf]])) == []


def test_null_gap_ends_a_track_at_its_first_miss(spark):
    boxes = spark.createDataFrame([("a", _hours(0), 1, 10.0, 80.0), ("a", _hours(6), 1, 10.1, 80.0)], "event string, valid_time timestamp_ntz, label_id long, centroid_lat double, centroid_lon double")
    frames = spark.createDataFrame([("a", _hours(k)) for k in (0, 3, 6)], "event string, valid_time timestamp_ntz")
    ids = lambda gap: [r.threat_id for r in tracks.track(boxes, frames, 100.0, gap).orderBy("valid_time").collect()]
    assert ids(None) == ["THR-2020-0001", "THR-2020-0002"]
    assert ids(1) == ["THR-2020-0001", "THR-2020-0001"]


def test_lifecycle_of_a_six_step_event(spark):
    rows = [("e", _hours(k), v, 1.0) for k, v in enumerate([1.0, 2.0, 3.0, 5.0, 4.0, 2.0])]
    df = spark.createDataFrame(rows, "threat_id string, timestamp timestamp_ntz, severity double, radius double")
    phases = [r.phase for r in series.lifecycle_phases(df).orderBy("timestamp").collect()]
    assert phases == ["FORMATION", "INTENSIFICATION", "INTENSIFICATION", "PEAK", "DECAY", "DECAY"]
    assert [r.phase for r in series.phase_changes(series.lifecycle_phases(df)).orderBy("timestamp").collect()] == ["FORMATION", "INTENSIFICATION", "PEAK", "DECAY"]
    empty = spark.createDataFrame([("e", T0, None, None)], df.schema)
    assert series.lifecycle_phases(empty).first().phase is None


def test_confusion_and_undefined_ratios(spark):
    pairs = [(True, True), (True, False), (False, True), (False, False)]
    rows = [p for p, n in zip(pairs, (2, 1, 1, 4), strict=True) for _ in range(n)]
    r = metrics.confusion(spark.createDataFrame(rows, "predicted boolean, reference boolean")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 4) and r.f1 == pytest.approx(2 / 3)
    none = metrics.confusion(spark.createDataFrame([(False, False)], "predicted boolean, reference boolean")).first()
    assert none.precision is None and none.recall is None and none.f1 is None


def test_scores(spark):
    s = spark.createDataFrame([(0.8, 1), (0.2, 0)], "p double, y int")
    assert metrics.brier_skill(s).first().brier == pytest.approx(0.04)
    assert metrics.roc_auc(s).first().auc == 1.0
    assert metrics.roc_auc(s.where("y = 1")).first().auc is None
    assert [r.n for r in metrics.reliability(s).orderBy("bin").collect()] == [0, 0, 1, 0, 0, 0, 0, 0, 1, 0]


def test_verdicts_need_every_threshold(spark):
    row = spark.range(1).select(
        metrics.verdict(F.lit(0.9), F.lit(0.8), F.lit(0.5), True).alias("a"), metrics.verdict(F.lit(0.6), F.lit(0.8), F.lit(0.5), True).alias("b"),
        metrics.verdict(F.lit(0.1), F.lit(0.8), F.lit(0.5), True).alias("c"), metrics.verdict(F.lit(0.1), F.lit(None).cast("double"), F.lit(0.5), True).alias("d"),
        metrics.verdict(F.lit(0.1), F.lit(0.2), F.lit(0.5), False).alias("e"),
    ).first()
    assert tuple(row) == ("PASS", "DEGRADE", "SUPPRESS", None, "PASS")


def test_bilinear_is_exact_on_a_ramp_and_null_outside(spark):
    field = spark.createDataFrame([(i, j, 2.0 * i + 3.0 * j) for i in (0, 2, 4) for j in (0, 2, 4)], "i long, j long, value double")
    axis = lambda n: spark.createDataFrame([(float(x),) for x in (0, 1, 2.5, 4, 5)], f"{n}_t double")
    for r in grids.bilinear(field, axis("i"), axis("j")).collect():
        assert r.value is None if max(r.i_t, r.j_t) > 4 else r.value == pytest.approx(2 * r.i_t + 3 * r.j_t)


def test_gram_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [([1.0, float(a)], float(b)) for a, b in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "x array<double>, y double")
    got = {(r.a, r.b): r.s for r in grids.normal_equations(df.repartition(7), 2).collect()}
    m = np.array([[*x, y] for x, y in rows])
    for (a, b), s in got.items():
        assert s == pytest.approx((m.T @ m)[a, b])
    w = grids.ridge(grids.normal_equations(df, 2), 2, 1e-9)
    assert np.allclose(w, np.linalg.lstsq(m[:, :2], m[:, 2], rcond=None)[0], atol=1e-6)


def test_upsert_keeps_old_keys_and_takes_new_rows(spark):
    old, new = (spark.createDataFrame(r, "k string, v int") for r in ([("a", 1), ("b", 1)], [("b", 2), ("c", 2)]))
    assert sorted(map(tuple, upsert(old, new, "k").collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_escalation_refuses_small_series(spark):
    rows = spark.createDataFrame([("a", 1)] * 30 + [("b", 0)] * 25 + [("c", 1)], "threat_id string, label int")
    assert {r.threat_id: r.refused for r in escalation.refusals(rows).collect()} == {"a": "too few negatives", "b": "too few positives", "c": "too few rows"}


def test_neighbourhood_mean_takes_the_nearest_cell_where_none_is_near(spark, monkeypatch):
    from galewatch.plans import series as plans

    rows = [(1, 12.5, 78.0, 10, 2.0), (2, 13.0, 79.0, 10, 4.0), (3, 15.0, 79.0, 10, 9.0), (3, 15.0, 79.0, 11, 9.0), (4, 10.0, 86.0, 11, 1.0)]
    cells = spark.createDataFrame(rows, "node_id long, latitude double, longitude double, valid_time long, value double")
    monkeypatch.setattr(plans, "observations", lambda *_: cells)
    got = {r.valid_time: (r["mean"], r.cells) for r in plans.neighbourhood_mean(spark, "").collect()}
    assert got == {10: (3.0, 2), 11: (9.0, 1)}
