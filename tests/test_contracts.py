"""Contracts, lookups, serving templates, sinks and forecasts on known cases."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from galewatch.functions import text as T
from galewatch.operators import alignment, contracts, horizons, metrics, series, serving
from galewatch.sources import sinks, tables


def test_expect_names_broken_rules(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "k int, p double")
    rules = [contracts.Rule("range", ~F.col("p").between(0, 1)), contracts.Rule("missing", F.col("p").isNull())]
    assert {tuple(r) for r in contracts.violations(df, rules).collect()} == {("range", 1), ("missing", 1)}
    with pytest.raises(contracts.ContractError, match="missing: 1 rows; range: 1 rows"):
        contracts.expect(df, rules)
    assert contracts.expect(df.where("p < 1"), rules).count() == 1
    assert {r.violations for r in contracts.violations(df.limit(0), rules).collect()} == {0}


def test_blocks_with_a_common_key_are_refused(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "t int") for v in ([1, 2], [2, 3]))
    with pytest.raises(contracts.ContractError):
        contracts.concat_blocks([a, b], "t")
    assert contracts.concat_blocks([a, b.where("t > 2")], "t").count() == 3
    assert {tuple(r) for r in contracts.set_difference(a, b, "t").collect()} == {(1, "left"), (3, "right")}


def test_names_rings_ranges_and_records(spark):
    df = spark.createDataFrame([(" SEVERE ", "THR-2024-0001", "3-5"), ("other", "THR-24-1", "5-3"), (None, None, "x")], "s string, i string, d string")
    got = df.select(T.one_of(F.col("s"), serving.RANKS), T.is_threat_id(F.col("i")), T.day_range(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("severe", True, [3, 4, 5]), (None, False, None), (None, False, None)]
    assert T.short_number(0.75) == "0.75" and T.short_number(1.0) == "1"
    rings = [([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]],), ([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]],), ([[0.0, 0.0]],), ([[0.0, 99.0], [1.0, 0.0], [1.0, 1.0], [0.0, 99.0]],), (None,), ([[0.0], [1.0, 0.0], [1.0, 1.0], [0.0]],)]
    problems = [r[0] for r in spark.createDataFrame(rings, "r array<array<double>>").select(T.ring_problem(F.col("r"))).collect()]
    assert problems == [None, "not closed", "fewer than four points", "outside the globe", "missing", "not pairs"]
    records = spark.createDataFrame([('{"target_severity": "severe", "window": {"hours": 24}}',), ("broken",)], "j string")
    assert [r[0] and (r[0].target_state, r[0].window_hours) for r in records.select(T.transition_from_json(F.col("j"))).collect()] == [("severe", 24.0), None]


def test_lookups_refuse_what_is_missing(spark):
    grid = spark.createDataFrame([(10.0, 76.0, 1.0), (10.5, 76.0, 2.0)], "latitude double, longitude double, v double")
    want = spark.createDataFrame([(10.0 + 1e-10, 76.0)], "latitude double, longitude double")
    assert [r.v for r in alignment.exact_lookup(want, grid).collect()] == [1.0]
    with pytest.raises(contracts.ContractError):
        alignment.exact_lookup(spark.createDataFrame([(11.0, 76.0)], want.schema), grid)
    with pytest.raises(ValueError):
        alignment.variable_column(grid, "mean_sea_level_pressure")
    with pytest.raises(contracts.ContractError):
        alignment.hold_out(grid, "longitude", 0.5)
    assert alignment.hold_out(grid, "latitude", 0.5).where("held_out").count() == 1


def test_axes_in_step_and_the_end_of_training(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    a, b = (spark.createDataFrame([(day(k),) for k in v], "valid_time timestamp_ntz") for v in ([1, 2, 3], [1, 2]))
    assert alignment.aligned(a, b).count() == 2
    with pytest.raises(contracts.ContractError):
        alignment.aligned(a, b.where("day(valid_time) = 2"))
    assert alignment.before_pilot(a, "2024-01-03", "INTERVAL 1 DAY").count() == 2
    with pytest.raises(contracts.ContractError):
        alignment.before_pilot(a, "2024-01-05", "INTERVAL 1 DAY")
    one = spark.createDataFrame([(0,)], "j int")
    assert {tuple(r) for r in alignment.axis_split(one, "j").collect()} == {(0, "train"), (0, "validate")}
    assert [r["steps"] for r in spark.createDataFrame([(10.0, 4.0), (1.0, 4.0), (14.0, 4.0), (1.0, 0.0)], "h double, s double").select(horizons.steps_ahead(F.col("h"), F.col("s")).alias("steps")).collect()] == [2, 1, 4, None]


def test_old_files_serve_one_region_only(spark):
    files = spark.createDataFrame([("a", "x"), ("old", None)], "path string, region string")
    names = lambda region: {r.path for r in alignment.region_files(files, region, "home").collect()}
    assert names("x") == {"a"} and names("y") == set() and names("home") == {"old"}
    assert {r.path for r in alignment.region_files(files, "x", "x").collect()} == {"a"}


def test_serving_lists_floors_and_variants(spark):
    t = spark.createDataFrame([("a", "moderate"), ("b", "severe"), ("c", "extreme"), ("d", "odd")], "threat_id string, severity string")
    assert [r.threat_id for r in serving.threat_list(t, None, 2).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        serving.threat_list(t, None, 501)
    assert {(r.threat_id, r.total) for r in serving.alerts(t, "severe").collect()} == {("b", 2), ("c", 2)}
    assert {(r.stage, r.ok, r.healthy) for r in serving.health({"x": t, "y": t.limit(0)}).collect()} == {("x", True, False), ("y", False, False)}


def test_gates_and_flags(spark):
    df = spark.createDataFrame([("iou", 0.5, True), ("iou", 0.2, True), ("rmse", 0.2, True), ("odd", 0.2, True), ("iou", None, True), ("iou", 0.9, False)], "m string, v double, t boolean")
    got = [r[0] for r in df.select(metrics.gate(F.col("m"), F.col("v"), F.col("t"), F.lit(0.4), F.lit(0.3))).collect()]
    assert got == ["PASS", "SUPPRESS", None, None, None, "SUPPRESS"]
    assert [r[0] for r in df.limit(2).select(metrics.gate(F.col("m"), F.col("v"), F.col("t"), F.lit(0.4), F.lit(0.3), F.lit(0.0), F.lit(0.0))).collect()] == ["PASS", "PASS"]
    rows = spark.createDataFrame([("t", 1, 5.0), ("t", 2, 1.0), ("t", 3, 4.0)], "threat_id string, timestamp int, severity double")
    flags = lambda tol: [(r.evaluated, r.event) for r in series.drop_flags(rows, "severity", tol).orderBy("timestamp").collect()]
    assert flags(2.0) == [(False, None), (True, True), (True, False)] and flags(None) == [(False, None)] * 3
    with pytest.raises(ValueError):
        series.escalation_threshold(rows, 1.0)


def test_folds_rollout_and_sweep(spark):
    labels = [0, 1, 0, 0, 1, 0, 1, 0, 0, 1, 0]
    rows = spark.createDataFrame([("t", k, v) for k, v in enumerate(labels)], "threat_id string, timestamp int, label int")
    got = [r.fold for r in horizons.stratified_folds(rows, 3, ["threat_id", "timestamp"]).orderBy("timestamp").collect()]
    assert got == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2] or sorted(got) == sorted(k % 3 for k in range(11))
    # fold sizes of each class as when sorted labels are dealt round-robin
    for c, at in ((0, 0), (1, 7)):
        n = labels.count(c)
        want = np.bincount(np.arange(at, at + n) % 3, minlength=3).tolist()
        assert [sum(1 for f, v in zip(got, labels) if f == k and v == c) for k in range(3)] == want
    start = spark.createDataFrame([(1, [1.0, 3.0])], "node_id int, history array<double>")
    out = [r.prediction for r in horizons.rollout(start, np.array([1.0, 0.5, 0.5]), 3).orderBy("step").collect()]
    assert out == [3.0, 4.0, 4.5]
    with pytest.raises(ValueError):
        horizons.rollout(start, np.array([1.0, 0.5, 0.5]), 25)
    xy = spark.createDataFrame([([1.0, float(k)], 2.0 * k + 1) for k in range(20)], "x array<double>, y double")
    sweep = {r.alpha: (r.rmse, r.chosen) for r in horizons.alpha_sweep(xy.where("x[1] < 15"), xy.where("x[1] >= 15"), 2, (0.0, 10.0)).collect()}
    assert sweep[0.0][0] < 1e-6 and sweep[0.0][1] and not sweep[10.0][1] and sweep[10.0][0] > 0.1


def test_sinks_write_what_readers_find(spark, tmp_path):
    a = spark.createDataFrame([("a", 1), ("b", 1)], "threat_id string, n int")
    b = spark.createDataFrame([("b", 2), ("c", 2)], a.schema)
    base = f"file://{tmp_path}"
    assert sinks.read_table(spark, f"{base}/t") is None
    sinks.upsert_table(a, f"{base}/t", "threat_id")
    sinks.upsert_table(b, f"{base}/t", "threat_id")
    assert {tuple(r) for r in sinks.read_table(spark, f"{base}/t").collect()} == {("a", 1), ("b", 2), ("c", 2)}
    sinks.write_records(a, f"{base}/r", source="test")
    assert spark.read.json(f"{base}/r/meta").first().asDict() == {"records": 2, "source": "test"}
    rows = spark.createDataFrame([(dt.datetime(y, 5, 1),) for y in (2018, 2020, 2023)], "valid_time timestamp_ntz")
    sinks.write_splits(rows, f"{base}/s")
    assert {(r.split, r.year) for r in spark.read.parquet(f"{base}/s").collect()} == {("train", 2018), ("validate", 2020), ("test", 2023)}
    box = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 3.0)], "label_id int, lat_min double, lat_max double, lon_min double, lon_max double")
    feature = json.loads(sinks.geojson(box).first()[0])
    assert feature["geometry"]["coordinates"][0][0] == feature["geometry"]["coordinates"][0][-1] == [2.0, 0.0] and feature["properties"] == {"label_id": 1}
    assert sinks.markdown(spark.createDataFrame([("x", None), ("y", 0.5)], "m string, v double")).endswith("| x | n/a |\n| y | 0.5 |")


def test_best_track_keeps_rows_that_do_not_parse(spark, tmp_path):
    (tmp_path / "t.csv").write_text("SID,SEASON,NAME,ISO_TIME,LAT,LON,USA_WIND\n ,Year, , ,degrees_north,degrees_east,kts\nS1,2019,fani,2019-05-01 00:00:00,12.0,88.0, \nS2,bad,x,never,1,2,30\n")
    got = tables.best_track(spark, f"file://{tmp_path}/t.csv").orderBy("sid").collect()
    assert [(r.sid, r.season, r.name, r.usa_wind) for r in got] == [("S1", 2019, "FANI", None), ("S2", None, "X", 30.0)]
    assert tables.select_track(tables.best_track(spark, f"file://{tmp_path}/t.csv"), name="fani").count() == 1
