"""Operators that must hold at any size: exact quantiles, components, moments, regions, bundles, generators."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galewatch import catalog
from galewatch.operators import components, detect, moments, quantiles, tracks
from galewatch.operators.contracts import ContractError, Rule
from galewatch.sources import bundles, regions, sinks, synthetic

DATA = "/root/testdata/sf0.001"
T0 = dt.datetime(2020, 1, 1)


# --- quantiles ---------------------------------------------------------------------------------------


def heavy(n):
    rng = np.random.default_rng(1)
    return [float(x) for x in np.exp(rng.normal(0, 6, n))]


COLUMNS = {
    "spread": [float(x) for x in np.random.default_rng(0).normal(0, 1, 6000)],
    "ties": [float(k % 3) for k in range(6000)] + [7.5] * 9000,
    "nulls": [None if k % 2 else float(k % 97) for k in range(5000)],
    "heavy tail": heavy(6000),
    "signs": [-0.0, 0.0, 1e-300, -1e-300, 1.7e308, -1.7e308] * 700,
    "one": [3.25],
    "two": [1.0, 2.0],
}


@pytest.mark.parametrize("name", COLUMNS)
@pytest.mark.parametrize("limit", [200, 1_000_000])
def test_quantiles_equal_percentile(spark, name, limit):
    rows = spark.createDataFrame([(v,) for v in COLUMNS[name]], "v double").repartition(3)
    at = [0.0, 0.013, 0.25, 0.5, 0.7501, 0.95, 0.99, 0.9999, 1.0]
    want = rows.agg(F.percentile("v", F.array(*map(F.lit, at))).alias("p")).first()["p"]
    got = quantiles.exact_quantiles(rows, "v", at, limit)
    same = lambda a, b: a == b or math.isnan(a) and math.isnan(b) or abs(a - b) <= 1e-12 * abs(b)
    assert all(map(same, got, want)), (got, want)


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([(None,), (math.nan,), (math.inf,)], "v double"), "v", [0.5, 1.0]) == [None, None]
    with pytest.raises(ValueError, match="between"):
        quantiles.exact_quantiles(spark.createDataFrame([(1.0,)], "v double"), "v", [1.5])


# --- components --------------------------------------------------------------------------------------


def spiral(n):
    """Cells of a spiral one cell wide, with a gap of one cell between its turns."""
    cells, r, c, step, turn = [(0, 0)], 0, 0, 2, 0
    for k in range(n):
        dr, dc = ((0, 1), (1, 0), (0, -1), (-1, 0))[turn % 4]
        for _ in range(step):
            r, c = r + dr, c + dc
            cells.append((r, c))
        turn += 1
        step += 2 * (k % 2)
    low = min(x for x, _ in cells), min(y for _, y in cells)
    return [(r - low[0], c - low[1]) for r, c in cells]


def test_rounds_are_few_on_a_spiral(spark):
    cells = spiral(24)
    rows = [(T0, r * 1000 + c, r, c) for r, c in cells] + [(T0, 900_000, 900, 0), (T0 + dt.timedelta(1), 5, 0, 5)]
    flags = spark.createDataFrame(rows, "valid_time timestamp_ntz, node_id long, lat_i long, lon_i long")
    got = detect.label_runs(flags).collect()
    assert len(got) == len(rows) and {(r.valid_time, r.label_id) for r in got} == {(T0, 1), (T0, 2), (T0 + dt.timedelta(1), 1)}
    chain = spark.range(1, 2001).select(F.col("id").alias("node"))
    links = spark.range(1, 2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    mixed = lambda c: F.xxhash64(c)  # noqa: E731  ids in no order along the chain
    roots, rounds = components.connected(chain.select(mixed("node").alias("node")), links.select(mixed("a").alias("a"), mixed("b").alias("b")))
    assert roots.select("root").distinct().count() == 1 and roots.count() == 2000 and rounds <= 11


# --- moments -----------------------------------------------------------------------------------------


def test_appended_moments_equal_a_recomputation(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), T0 + dt.timedelta(days=rng.randrange(200)), rng.choice([None, 1e9 + rng.gauss(0, 1e-2)])) for _ in range(3000)]
    table = spark.createDataFrame(rows, "k string, t timestamp_ntz, v double")
    path = tmp_path.as_uri() + "/moments"
    for m in (1, 2, 3, 3, 4, 5, 6, 7):  # a month comes twice
        moments.add_months(table.where(F.month("t") == m), path, "v", "t", "k")
    got = {r.k: (r.n, r.mean, r["std"]) for r in moments.statistics(spark, path, "k").collect()}
    for k in "ab":
        v = np.array([x - 1e9 for key, _, x in rows if key == k and x is not None])
        n, mean, std = got[k]
        assert n == len(v) and abs(mean - 1e9 - v.mean()) < 1e-6 and abs(std / v.std() - 1) < 1e-4
    flat = spark.createDataFrame([("c", T0, 0.1), ("c", T0 + dt.timedelta(40), 0.1), ("c", T0 + dt.timedelta(80), 0.1)], table.schema)
    moments.add_months(flat, path, "v", "t", "k")
    with pytest.raises(ContractError, match="no deviation"):
        moments.statistics(spark, path, "k")
    with pytest.raises(ContractError, match="no moments"):
        moments.statistics(spark, path + "-none", "k")


def test_parts_merge_in_any_way(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("part"), F.when(F.col("id") % 9 != 0, F.sin("id")).alias("v"))
    whole = moments.merged(moments.parts(rows, "v")).first()
    some = moments.parts(rows, "v", "part")
    left, right = moments.merged(some.where("part < 3")), moments.merged(some.where("part >= 3"))
    twice = moments.merged(left.unionByName(right)).first()
    assert whole["n"] == twice["n"] and abs(whole["mean"] - twice["mean"]) < 1e-12 and abs(whole["m2"] - twice["m2"]) < 1e-9


def test_two_writers_from_one_version(spark, tmp_path):
    path = tmp_path.as_uri() + "/table"
    a, b = (spark.createDataFrame([(k, v)], "k int, v int") for k, v in ((1, 1), (2, 2)))
    sinks.upsert_table(a, path, "k")
    assert sorted(map(tuple, sinks.upsert_table(b, path, "k").collect())) == [(1, 1), (2, 2)]
    with pytest.raises(ContractError, match="another writer has made version 1"):
        sinks._name_version(spark, path, 1, "v-of-another")
    assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == [(1, 1), (2, 2)]


# --- regions -----------------------------------------------------------------------------------------


def test_scans_read_the_folders_that_they_need(spark, tmp_path):
    path = tmp_path.as_uri() + "/regions"
    rows = [(r, T0 + dt.timedelta(days=200 * k), float(k)) for r in ("a", "b", None) for k in range(5)]
    regions.write_regions(spark.createDataFrame(rows, "region string, valid_time timestamp_ntz, value double"), path)
    one = regions.of_region(spark, path, "a", 2020, 2021)
    assert sorted(r.value for r in one.collect()) == [0.0, 1.0, 2.0, 3.0]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region" in plan and "DataFilters: []" in plan
    wanted = spark.createDataFrame([("b", 1), ("b", 2), (None, 3), ("c", 1)], "region string, k int")
    joined = regions.of_regions(spark, path, wanted.where("k < 3"))
    assert sorted((r.region, r.value) for r in joined.collect()) == [("b", float(k)) for k in range(5)]
    assert "dynamicpruning" in joined._jdf.queryExecution().toString().lower()
    assert regions.read_regions(spark, path).where("region is null").count() == 5


# --- bundles -----------------------------------------------------------------------------------------


def bundle(spark, frames=4, nodes=3):
    times = spark.createDataFrame([(T0 + dt.timedelta(hours=k),) for k in range(frames)], "valid_time timestamp_ntz")
    mesh = spark.createDataFrame([(n, 10.0 + n, 76.0) for n in range(nodes)], "node_id long, latitude double, longitude double")
    cells = times.join(mesh.select("node_id")).withColumns({"t2m": F.col("node_id") + 0.5, "msl": F.lit(1000.0)})
    record = {"frames": frames, "nodes": nodes, "features": ["t2m", "msl"], "first": str(T0), "last": str(T0 + dt.timedelta(hours=frames - 1))}
    return cells, record, times, mesh


def broken(spark):
    at = F.lit(T0)
    cells, record, times, mesh = bundle(spark)
    first = (F.col("node_id") == 1) & (F.col("valid_time") == at)
    later = F.col("valid_time") + F.expr("INTERVAL 30 MINUTES")
    return {
        "record_frames": (cells, record | {"frames": 5}, times, mesh),
        "record_nodes": (cells, record | {"nodes": 2}, times, mesh),
        "record_features": (cells, record | {"features": ["msl", "t2m"]}, times, mesh),
        "record_last": (cells, record | {"last": "2021"}, times, mesh),
        "times_repeated": (cells, record, times.unionByName(times.limit(1)), mesh),
        "times_spacing": (cells, record, times.where(F.col("valid_time") != F.lit(T0 + dt.timedelta(hours=1))), mesh),
        "node_table": (cells, record, times, mesh.withColumn("node_id", F.col("node_id") + 1)),
        "tensor_features": (cells.drop("msl"), record, times, mesh),
        "tensor_cells": (cells.where(~first), record, times, mesh),
        "tensor_repeated": (cells.where(~first).unionByName(cells.where("node_id = 2").limit(1)), record, times, mesh),
        "cell_without_frame": (cells.withColumn("valid_time", F.when(first, later).otherwise(F.col("valid_time"))), record, times, mesh),
        "cell_without_node": (cells.withColumn("node_id", F.when(first, 9).otherwise(F.col("node_id"))), record, times, mesh),
        "value_missing": (cells.withColumn("t2m", F.when(~first, F.col("t2m"))), record, times, mesh),
        "value_missing ": (cells.withColumn("t2m", F.when(first, float("nan")).otherwise(F.col("t2m"))), record, times, mesh),
    }


def test_bundles_that_disagree_are_refused_by_name(spark, tmp_path):
    cells, record, times, mesh = bundle(spark)
    path = f"{tmp_path.as_uri()}/bundle"
    assert bundles.check_bundle(cells, record, times, mesh, ("t2m", "msl"), path) == {"rows": 12, "frames": 4, "nodes": 3}
    assert spark.read.parquet(path).count() == 12
    for name, (c, r, t, m) in broken(spark).items():
        features = ("t2m", "msl")
        with pytest.raises(ContractError, match=name.strip()):
            bundles.check_bundle(c, r, t, m, features, f"{path}-{name.strip()}")
        assert not (tmp_path / f"bundle-{name.strip()}").exists()
    with pytest.raises(ContractError, match="there already"):
        bundles.check_bundle(cells, record, times, mesh, ("t2m", "msl"), path)


def test_checked_writes_read_their_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(100).mapInArrow(count, "id long")
    path = tmp_path.as_uri() + "/out"
    got = bundles.write_checked(rows, path, [Rule("negative", F.col("id") < 0)], top=F.max("id"))
    assert got == {"rows": 100, "top": 99} and seen.value == 100 and spark.read.parquet(path).count() == 100
    with pytest.raises(ContractError, match="large: 10 rows"):
        bundles.write_checked(spark.range(100), path + "2", [Rule("large", F.col("id") >= 90)])
    assert not (tmp_path / "out2").exists()


# --- generators --------------------------------------------------------------------------------------


def test_fields_do_not_depend_on_partitions(spark):
    cells = synthetic.grid(spark, 11, 6, 20, "2020-05-16 00:00:00")
    fields = [{(r.frame, r.node_id): r.value for r in synthetic.seeded_field(cells.repartition(k), 7, 3.0, 2.0).collect()} for k in (1, 7)]
    assert fields[0] == fields[1] and len(fields[0]) == 20 * 66
    v = np.array(list(fields[0].values()))
    assert abs(v.mean() - 3) < 0.2 and abs(v.std() - 2) < 0.2
    assert fields[0] != {(r.frame, r.node_id): r.value for r in synthetic.seeded_field(cells, 8, 3.0, 2.0).collect()}
    synthetic.register_sources(spark)
    load = lambda **o: {(r.frame, r.node_id, r.lat_i, r.lon_i): r.value for r in spark.read.format("seeded_field").options(**o).load().collect()}
    a, b = load(frames=9, partitions=1), load(frames=9, partitions=7)
    assert a == b and len(a) == 9 * 66 and load(frames=0) == {} and a != load(frames=9, seed=1)
    assert abs(np.std(list(a.values())) - 1) < 0.1


def test_smooth_and_sharp_fields(spark):
    cells = synthetic.grid(spark, 20, 20, 1, "2020-05-16 00:00:00", step=0.25)
    sharp = synthetic.sharp_field(cells, 20.0, 60.0, (12.0, 78.0), 30.0).agg(F.max("value").alias("m"), F.max_by("node_id", "value").alias("n"), F.min("value").alias("low")).first()
    assert sharp["m"] == 80.0 and sharp["n"] == 8 * 20 + 8 and 20 <= sharp["low"] < 20.01
    smooth = synthetic.smooth_field(cells, 5.0, 2.0, 4.0)
    ends = smooth.agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
    assert 3 <= ends["a"] < 3.1 and 6.9 < ends["b"] <= 7


def test_detector_and_tracker_follow_a_moving_event(spark):
    """A peak that moves by one node to the east each frame over weak noise: one track, at the known places."""
    cells = synthetic.grid(spark, 12, 16, 10, "2020-05-16 00:00:00", hours=3.0, step=1.0)
    field = synthetic.moving_event(cells, (15.0, 78.0), (0.0, 1.0), 40.0, 110.0, seed=3, noise=0.5)
    z = field.withColumn("z", F.col("value") / 4.0)
    boxes = detect.region_boxes(detect.label_regions(z.where("z > 2.5").select("valid_time", "node_id", "lat_i", "lon_i", "latitude", "longitude", "z"))).withColumn("event", F.lit("e"))
    frames = cells.select(F.lit("e").alias("event"), "valid_time").distinct()
    tracked = tracks.track(boxes, frames, 250.0, 1).orderBy("valid_time").collect()
    assert [r.threat_id for r in tracked] == ["THR-2020-0001"] * 10
    assert [(round(r.centroid_lat), round(r.centroid_lon)) for r in tracked] == [(15, 78 + k) for k in range(10)]
    steps = tracks.steps(spark.createDataFrame(tracked), "threat_id").collect()
    assert len(steps) == 9 and all(abs(s.bearing_deg - 90) < 8 and 90 < s.distance_km < 125 for s in steps)


def test_registered_queries_hold_no_percentile_buffer(spark):
    for name in ("field_summary", "percentile_error", "quantile_knots", "quantile_map"):
        assert "percentile(" not in catalog.queries()[name](spark, DATA)._jdf.queryExecution().toString()
