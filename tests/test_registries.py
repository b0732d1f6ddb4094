"""Functions by name, staged evaluation, indicators and presets against plain loops."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.operators import folds, indicators, registries, staged

DAY = dt.date(2012, 1, 6)


@pytest.fixture(scope="module")
def data():
    rng, out = np.random.default_rng(7), {}
    for k in ("a", "b"):
        x = rng.normal(size=(160, 2))
        y = np.cumsum(0.5 * x[:, 0] + rng.normal(size=160) * 0.2)
        out[k] = (y, np.column_stack([np.concatenate([[0], y[:-1]]), x]))
    return out


@pytest.fixture(scope="module")
def df(spark, data):
    rows = [(k, DAY + dt.timedelta(weeks=i), float(y[i]), *map(float, x[i])) for k, (y, x) in data.items() for i in range(160)]
    rows += [("a", DAY - dt.timedelta(weeks=1), None, 0.0, 0.0, 0.0), ("short", DAY, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "k string, d date, y double, last double, u double, v double").repartition(4)


def test_expanding_fits_are_refits(data):
    y, x = data["a"]
    for ridge in (0.0, 2.0):
        fits = staged.expanding_fits(x, y, ridge)
        assert len(fits) == 161
        for n in (10, 77, 160):
            z = np.column_stack([np.ones(n), x[:n]])
            np.testing.assert_allclose(fits[n], np.linalg.solve(z.T @ z + ridge * np.diag([0.0, 1, 1, 1]), z.T @ y[:n]), atol=1e-8)
    assert [staged.n_splits(*a) for a in ((100, 60), (100, 60, 7), (60, 60), (61, 60), (100, 60, 1, 5))] == [40, 6, 0, 1, 36]


def test_stages_as_loops(df, data):
    got = {(r.k, r.stage): r for r in staged.staged_evaluation(df, "k", "d", "y", ["last", "u", "v"], test=0.25, least=60, step=3).collect()}
    assert set(got) == {(k, s) for k in "ab" for s in ("cv", "test", "refit")}
    for k, (y, x) in data.items():
        fit = lambda n, x=x, y=y: np.linalg.lstsq(np.column_stack([np.ones(n), x[:n]]), y[:n], rcond=None)[0]
        say = lambda i, b, x=x: b[0] + x[i] @ b[1:]
        cv = [(y[i] - say(i, fit(i)), y[i] - y[i - 1]) for i in range(60, 120, 3)]
        test = [(y[i] - say(i, fit(120)), y[i] - y[i - 1]) for i in range(120, 160)]
        for stage, errors in (("cv", cv), ("test", test)):
            r, e, naive = got[k, stage], np.array([a for a, _ in errors]), np.array([b for _, b in errors])
            assert r.n == len(e) and r.rmse == pytest.approx(math.sqrt((e**2).mean())) and r.mae == pytest.approx(np.abs(e).mean()) and r.naive_rmse == pytest.approx(math.sqrt((naive**2).mean()))
            assert r.direction == pytest.approx(np.mean(np.sign(naive - e) == np.sign(naive)))
        assert got[k, "cv"].n == staged.n_splits(120, 60, 3)
        ratio = got[k, "test"].rmse / got[k, "cv"].rmse
        assert got[k, "test"].ratio == pytest.approx(ratio) and got[k, "test"].passed == (ratio < 1.5)
        np.testing.assert_allclose(got[k, "refit"].coef, fit(160), atol=1e-8)
    few = {(r.k, r.stage) for r in staged.staged_evaluation(df, "k", "d", "y", ["u"], least=200).collect()}
    assert few == {(k, s) for k in "ab" for s in ("test", "refit")}


def test_named_transforms(df):
    named = registries.pipeline(df.select("k", "d", "y"), ["change", "clip3"], "k", "d", "y")
    got = {(r.k, r.d): r.y for r in named.collect()}
    y = {r.d: r.y for r in df.where("k = 'a'").collect()}
    want = y[DAY + dt.timedelta(weeks=5)] - y[DAY + dt.timedelta(weeks=4)]
    assert got["a", DAY + dt.timedelta(weeks=5)] == pytest.approx(max(-3, min(3, want))) and got["a", DAY] is None
    with pytest.raises(KeyError):
        registries.pipeline(df, ["change", "unheard"], "k", "d", "y")


def test_named_estimators_and_models(df, data):
    got = {(r.k, r.estimator): r.value for r in registries.estimate(df, list(registries.ESTIMATORS), "k", "d", "y").collect()}
    for k, (y, _) in data.items():
        assert got[k, "median"] == pytest.approx(np.median(y)) and got[k, "trend"] == pytest.approx(np.polyfit(np.arange(160), y, 1)[0]) and got[k, "persistence"] == pytest.approx(np.corrcoef(y[1:], y[:-1])[0, 1])
    assert got["short", "mean"] == 1.0 and got["short", "trend"] is None
    board = {(r.k, r.model, r.features): r for r in registries.tournament(df, "k", "y", list(registries.MODELS), {"one": ["u"], "all": ["last", "u", "v"]}).collect()}
    y, x = data["b"]
    z = np.column_stack([np.ones(160), x])
    e = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    assert board["b", "ols", "all"].rmse == pytest.approx(math.sqrt((e**2).mean())) and board["b", "mean", "one"].rmse == pytest.approx(y.std()) and board["b", "ols", "all"].rmse <= board["b", "ridge", "all"].rmse <= board["b", "mean", "all"].rmse


def test_named_statistics(df, data):
    for name, f in (("mean", np.mean), ("median", np.median), ("deviation", np.std), ("highest", np.max)):
        got = {r.k: r for r in registries.bootstrap(df, name, "k", "d", "y").collect()}
        assert got["a"].observed == pytest.approx(f(data["a"][0])) and got["a"].low <= got["a"].observed <= got["a"].high + 1e-12 and got["short"].low == got["short"].high


def test_readings(df, data):
    part = indicators.latest_reading(df, "one", "k", "d", "y", 50)
    out = {(r.k, r.indicator): r for r in indicators.all_indicators([part, None], ["one", "two"], df.select("k"), "k").collect()}
    assert set(out) == {(k, i) for k in ("a", "b", "short") for i in ("one", "two")}
    for k, (y, _) in data.items():
        z = (y[-1] - y[-50:].mean()) / y[-50:].std()
        r = out[k, "one"]
        assert r.z == pytest.approx(z) and r.available and r.read == ("bear" if z > 1 else "bull" if z < -1 else "neutral") and r.date == DAY + dt.timedelta(weeks=159)
    assert out["short", "one"].read == out["a", "two"].read == "n/a" and not out["a", "two"].available
    assert {r.read for r in indicators.all_indicators([None], ["one"], df.select("k"), "k").collect()} == {"n/a"}


def test_variance_presets(df, data):
    got = {(r.k, r.preset): (r.obs, r.level, r.slope) for r in folds.preset_variances(df, "k", "y").collect()}
    for name, scale in folds.PRESETS.items():
        assert got["a", name] == pytest.approx([data["a"][0].var() * s for s in scale]) and got["short", name] == pytest.approx(scale)


def test_moving_regression_of_an_exact_fit():
    x = np.linspace(0, 1, 60)
    out = folds.kalman_regression(2 + 3 * x, x)
    assert abs(out["resid"][-1]) < 1e-2 and out["alpha"][-1] + out["beta"][-1] == pytest.approx(5, abs=1e-2)
    assert np.isnan(folds.kalman_regression(x[:20], x[:20])["alpha"]).all()
    flat = folds.kalman_regression(np.sin(np.arange(50.0)), np.ones(50))
    assert np.isfinite(flat["beta"]).all()


def test_callback_sees_each_row_once(spark, tmp_path):
    from tidalframe.streaming import feeds

    df = spark.range(50).select((F.col("id") % 3).alias("k"), "id")
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    run = lambda: {r.k: r.n for r in feeds.with_callback(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in"), lambda b: b.groupBy("k").count(), f"{tmp_path}/out", f"{tmp_path}/ck").groupBy("k").agg(F.sum("count").alias("n")).collect()}
    assert run() == {0: 17, 1: 17, 2: 16} == run()
