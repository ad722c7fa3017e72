"""Fitted queries against plain NumPy recomputations from the same rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galewatch import catalog
from galewatch.operators import alignment, contracts, detect, downscaling, grids, horizons, series
from galewatch.plans import grids as grid_plans
from galewatch.plans import horizons as horizon_plans
from galewatch.plans.series import _transition
from galewatch.sources import sinks
from galewatch.sources.tables import fine_field, observations

DATA = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def run(spark, name, d=DATA):
    return catalog.queries()[name](spark, d).toPandas()


def ridge(x, y, alpha):
    penalty = alpha * np.eye(x.shape[1])
    penalty[0, 0] = 0
    return np.linalg.solve(x.T @ x + penalty + 1e-9 * np.diag(np.arange(x.shape[1]) > 0), x.T @ y)


def around(field, radius):
    """1, the centre, and the neighbours less the centre, with the edge repeated."""
    n, m = field.shape
    pad = np.pad(field, radius, mode="edge")
    side = range(2 * radius + 1)
    near = [pad[a : a + n, b : b + m] - field for a in side for b in side]
    return np.stack([np.ones_like(field), field, *near], -1)


def test_ridge_fit(spark):
    got = run(spark, "ridge_fit").sort_values(["i", "j"])
    rows = grid_plans._rows(spark, DATA).toPandas().sort_values(["i", "j"])
    x, y = np.vstack(rows["x"]), rows["y"].to_numpy()
    assert np.allclose(got["fitted"], x @ ridge(x, y, 0.1)) and np.allclose(got["y"], y) and len(got) == 361


def test_autoregression(spark):
    obs = observations(spark, DATA).toPandas().sort_values(["node_id", "valid_time"])
    x, y, last = [], [], {}
    for n, g in obs.groupby("node_id"):
        v = g["value"].to_numpy()
        x += [[1.0, *v[k - 6 : k]] for k in range(6, len(v))]
        y += list(v[6:])
        if len(v) > 6:
            last[n] = list(v[-6:])
    w = ridge(np.array(x), np.array(y), 1.0)
    got = run(spark, "autoregression")
    want = {}
    for n, h in last.items():
        for step in (1, 2, 3):
            p = w @ [1.0, *h]
            h = [*h[1:], p]
            want[n, step] = p
    assert {(r.node_id, r.step) for r in got.itertuples()} == set(want) and want
    assert all(abs(want[r.node_id, r.step] - r.prediction) < 1e-5 for r in got.itertuples())


def test_radius_sweep(spark):
    got = {r.radius: r.rmse for r in run(spark, "radius_sweep").itertuples()}
    fine = fine_field(spark, DATA).toPandas().pivot(index="i", columns="j", values="value").to_numpy()
    smooth = (around(fine, 1)[..., 2:] + fine[..., None]).mean(-1)
    test = np.arange(20) % 4 == 3
    for r in (0, 1, 2):
        x = around(smooth, r)
        w = ridge(x[:, ~test].reshape(-1, x.shape[-1]), fine[:, ~test].ravel(), 1.0)
        assert abs(np.sqrt(np.mean((x[:, test] @ w - fine[:, test]) ** 2)) - got[r]) < 2e-3
    plan = catalog.queries()["radius_sweep"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def logistic(x, y, scored):
    """Population-standardised features, L2 of strength 1 on all but the intercept, by Newton steps."""
    m, s = x.mean(0), x.std(0)
    s[s == 0] = 1
    z = np.c_[np.ones(len(x)), (x - m) / s]
    w, penalty = np.zeros(z.shape[1]), np.diag(np.r_[0, np.ones(x.shape[1])])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
    return 1 / (1 + np.exp(-np.c_[np.ones(len(scored)), (scored - m) / s] @ w))


@pytest.fixture(scope="module")
def eligible(spark):
    rows = _transition(spark, DATA).toPandas().sort_values(["threat_id", "timestamp"]).reset_index(drop=True)
    return rows, rows[["severity", "tendency", "radius"]].to_numpy(float), rows["label"].to_numpy()


def dealt(y, folds=5):
    """Labels sorted by class (that of the first row first) are dealt in turn; a class's rows fill their shares in order."""
    first = y[0]
    order = np.sort(np.where(y == first, 0, 1))
    share = [[int(((order == c) & (np.arange(len(y)) % folds == f)).sum()) for f in range(folds)] for c in (0, 1)]
    fold = np.zeros(len(y), int)
    for c, mine in ((0, y == first), (1, y != first)):
        fold[mine] = np.repeat(np.arange(folds), share[c])
    return fold


def by_row(frame, column):
    return frame.sort_values(["threat_id", "timestamp"])[column].to_numpy(float)


def test_transition_fit(spark, eligible):
    _, x, y = eligible
    assert np.allclose(by_row(run(spark, "transition_fit"), "probability"), logistic(x, y, x), atol=2e-3)


def test_transition_oof_and_serve(spark, eligible):
    rows, x, y = eligible
    got = run(spark, "transition_oof")
    fold = dealt(y)
    assert (by_row(got, "fold") == fold).all()
    want = np.zeros(len(y))
    for f in range(5):
        want[fold == f] = logistic(x[fold != f], y[fold != f], x[fold == f])
    p = by_row(got, "probability")
    assert np.allclose(p, want, atol=2e-3)
    served = {}
    for k, g in rows.assign(p=p).groupby("threat_id"):
        base = g["label"].mean()
        if base in (0, 1):
            continue
        skill = 1 - ((g["p"] - g["label"]) ** 2).mean() / (base * (1 - base))
        rank, pos = g["p"].rank(), g["label"].sum()
        auc = (rank[g["label"] == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(g) - pos))
        if skill > 0 and auc > 0.5:
            last = g.sort_values("timestamp").iloc[-1]
            served[k] = (last["timestamp"], round(last["p"], 4))
    assert {r.threat_id: (r.timestamp, round(r.probability, 4)) for r in run(spark, "transition_serve").itertuples()} == served


def test_downscaling_scores(spark):
    pairs = horizon_plans._sequence(spark, DATA.replace("0.001", "0.01")).toPandas()
    cube = {t: (g.pivot(index="i", columns="j", values="p").to_numpy(float), g.pivot(index="i", columns="j", values="r").to_numpy(float)) for t, g in pairs.groupby("valid_time")}
    cut = np.quantile(np.arange(20), 0.7)
    j = np.arange(19)
    train = j[j < cut]
    inner = round(0.85 * len(train))
    x = np.stack([around(p[:19, :19], 1) for p, _ in cube.values()])
    y = np.stack([r[:19, :19] for _, r in cube.values()])
    flat = lambda cols: (x[:, :, cols].reshape(-1, 11), y[:, :, cols].ravel())
    rmse = lambda w, cols: np.sqrt(np.mean((flat(cols)[0] @ w - flat(cols)[1]) ** 2))
    alphas = (0.1, 1.0, 10.0, 100.0)
    alpha = min(alphas, key=lambda a: rmse(ridge(*flat(train[:inner]), a), train[inner:]))
    w = ridge(*flat(train), alpha)
    fitted, held = flat(train)[0] @ w, j[j >= cut]
    at = np.linspace(0, 1, 101)
    kx, ky = np.quantile(fitted, at), np.quantile(flat(train)[1], at)
    hx, hy = flat(held)
    want = {"interpolated": hx[:, 1], "ridge": hx @ w, "ridge_mapped": np.interp(hx @ w, kx, ky)}
    got = {r.method: r for r in run(spark, "downscaling_scores", DATA.replace("0.001", "0.01")).itertuples()}
    for m, p in want.items():
        e = p - hy
        assert got[m].cells == len(hy) and abs(got[m].rmse - np.sqrt((e**2).mean())) < 1e-4 and abs(got[m].mae - abs(e).mean()) < 1e-4 and abs(got[m].bias - e.mean()) < 1e-4
        assert abs(got[m].peak_preservation - p.max() / hy.max()) < 1e-4


def test_sequences_that_cannot_be_scored(spark):
    rows = [(T0, i, j, float(i + j), float(i + j)) for i in range(8) for j in range(10)]
    make = lambda change: spark.createDataFrame([(t, i, j, *change(i, j, p, r)) for t, i, j, p, r in rows], "valid_time timestamp_ntz, i long, j long, p double, r double")
    good = downscaling.evaluate(make(lambda i, j, p, r: (p, r)))
    assert good.status == "scored" and good.steps.count() == 3 and good.sweep.where("chosen").count() == 1
    found = {r.method: r.rmse for r in good.scores.collect()}
    assert found["interpolated"] < 1e-12 and found["ridge"] < 0.1  # the penalty pulls a little
    lost = downscaling.evaluate(make(lambda i, j, p, r: (p, None if i + j > 14 else r)))
    assert lost.status == "not_scoreable" and "peaks" in lost.reason and lost.scores is None
    thin = downscaling.evaluate(make(lambda i, j, p, r: (p if j < 9 or i < 7 else 0.0, r if j < 7 or j == 8 and i == 7 else None)))
    assert thin.status == "not_scoreable" and "held-out" in thin.reason
    assert downscaling.evaluate(make(lambda i, j, p, r: (None, r))).reason == "the coarse field has no value"
    with pytest.raises(contracts.ContractError):
        downscaling.evaluate(make(lambda i, j, p, r: (p, r)).where("j = 0"))


def test_divergence_of_known_winds(spark):
    """A wind that grows by 1 m/s a cell eastward and northward: known divergence, whichever way rows come; holes spread."""
    rows = [(10.0 + 0.5 * i, 80.0 + 0.5 * j, float(j), float(i)) for i in range(5) for j in range(5)]
    table = spark.createDataFrame(rows, "latitude double, longitude double, u double, v double")
    metres = 0.5 * np.pi / 180 * 6_371_000
    got = {(r.latitude, r.longitude): r.divergence for r in grids.divergence(table).collect()}
    assert len(got) == 25 and all(abs(d - (1 / (metres * np.cos(np.radians(11.0))) + 1 / metres)) < 1e-15 for d in got.values())
    holed = {(r.latitude, r.longitude): r.divergence for r in grids.divergence(table.where("not (latitude = 11 and longitude = 81)")).collect()}
    assert [k for k, d in sorted(holed.items()) if d is None] == [(10.5, 81.0), (11.0, 80.5), (11.0, 81.5), (11.5, 81.0)]


def test_explanations(spark):
    schema = "threat_id string, timestamp timestamp_ntz, pressure_tendency_3h_hpa double, wind_divergence_s1 double, precipitation_rate_mm3h double, t2m_anomaly_k double"
    rows = [
        ("fall", T0, -9.0, -2e-5, 1.0, -2.5), ("fall", T0 + dt.timedelta(hours=3), -2.0, None, 12.3, None),
        ("calm", T0, 1.5, 0.0, 2.0, 2.0), ("none", T0, None, None, None, None), ("rain", T0, None, -6e-5, 2.5, 3.0),
    ]
    got = {r.threat_id: r.summary for r in series.explanations(spark.createDataFrame(rows, schema)).collect()}
    assert got["fall"] == "Evolution driven by steady pressure falls (most recent: -2.0 hPa/3h), with supporting signals: moderate low-level convergence (div: -2.00e-05 s⁻¹); intense precipitation (12.3 mm/3h at centroid); negative surface temperature anomaly (-2.5 K)."
    assert got["calm"] == "Evolution driven by near-steady pressure (most recent: +1.5 hPa/3h)."
    assert got["none"] == "No significant precursor signal detected in the analysed window."
    assert got["rain"].startswith("Evolution driven by strong low-level wind convergence (div: -6.00e-05 s⁻¹), with supporting signals: moderate precipitation")


def test_refusals_of_histories_and_climatologies(spark):
    rows = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(1)), ("b", T0)], "threat_id string, timestamp timestamp_ntz")
    assert [r.threat_id for r in contracts.ordered_history(rows).collect()] == ["a", "a", "b"]
    for bad, name in ((("a", T0), "time_repeated"), (("a", None), "time_missing"), ((None, T0), "key_missing")):
        with pytest.raises(contracts.ContractError, match=name):
            contracts.ordered_history(rows.unionByName(spark.createDataFrame([bad], rows.schema)))
    clim = spark.createDataFrame([(k, 0, 1.0 if k else None, 1.0) for k in range(10)], "lat_i long, lon_i long, mean double, std double")
    assert detect.sufficient(clim).count() == 10
    with pytest.raises(contracts.ContractError, match="80.0%"):
        detect.sufficient(clim.where("lat_i < 5"))


def test_time_axis_lookups_and_frame_files(spark, tmp_path):
    cells = spark.createDataFrame([(T0, 1)], "valid_time timestamp_ntz, k int")
    assert alignment.canonical_time(cells).columns == ["time", "k"] and alignment.canonical_time(cells.withColumnRenamed("valid_time", "time")).columns == ["time", "k"]
    beside = alignment.enrich(cells, spark.createDataFrame([(2, "x")], "k int, name string"), "k").first()
    assert beside["name"] is None and beside["k"] == 1
    sinks.write_frames(cells, cells.withColumn("step", F.lit(3)), tmp_path.as_uri() + "/run")
    assert spark.read.json(tmp_path.as_uri() + "/run/frames").count() == 1 and spark.read.json(tmp_path.as_uri() + "/run/trajectory").first()["step"] == 3


def test_folds_are_dealt_by_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{k % 4}", T0 + dt.timedelta(days=17 * k), int(rng.random() < 0.3)) for k in range(200)]
    table = spark.createDataFrame(rows, "threat_id string, timestamp timestamp_ntz, label int")
    got = horizons.stratified_folds(table, 5, ["threat_id", "timestamp"]).toPandas().sort_values(["threat_id", "timestamp"])
    assert (got["fold"].to_numpy() == dealt(got["label"].to_numpy())).all() and isinstance(got, pd.DataFrame)
