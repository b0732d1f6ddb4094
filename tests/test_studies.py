"""Composed studies on small inputs: nulls, empty tables, ties, and plain recomputation."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.operators import linear, studies


def days(n):
    return [dt.date(2020, 1, 1) + dt.timedelta(days=20 * k) for k in range(n)]


def test_component_composites_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3))
    x[:, 1] += x[:, 0]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)] + [(50, None, 1.0, 1.0)], "i int, a double, b double, c double")
    got = studies.component_composites(df.where("a is not null"), ["a", "b", "c"]).orderBy("i").toPandas()
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    vectors, values = vectors[:, ::-1], values[::-1]
    vectors = vectors * (1 if np.corrcoef(z[:, 0], z @ vectors[:, 0])[0, 1] > 0 else -1)
    kept = values > 1
    want = z @ vectors[:, kept] @ (values[kept] / values[kept].sum())
    if kept.sum() == 1:  # the sign of further components is not determined
        assert got["kaiser"].to_numpy() == pytest.approx(want)
    j = next(j for j in range(3) if vectors[:, j].min() < 0 < vectors[:, j].max())
    assert got["opposed"].to_numpy() == pytest.approx(z @ vectors[:, j] * np.sign(vectors[0, j]))


def test_largest_breaks_ties_by_name_and_drops_nulls(spark):
    df = spark.createDataFrame([("g", "b", -2.0), ("g", "a", 2.0), ("g", "c", 1.0), ("g", "d", None), (None, "x", 0.0)], "g string, n string, w double")
    got = {(r["g"], r["n"]): r["place"] for r in studies.largest(df, "g", "n", "w", 2).collect()}
    assert got == {("g", "a"): 1, ("g", "b"): 2, (None, "x"): 1}
    assert studies.largest(df.limit(0), "g", "n", "w", 2).count() == 0


def test_by_prefix_counts_nulls_as_zero(spark):
    df = spark.createDataFrame([(1, 2.0, None, 5.0), (2, None, None, None)], "k int, u_a double, u_b double, v_a double")
    assert [tuple(r) for r in studies.by_prefix(df, ["k"]).orderBy("k").collect()] == [(1, 2.0, 5.0), (2, 0.0, 0.0)]


def test_posterior_interval_of_no_values_is_the_prior(spark):
    df = spark.createDataFrame([("a", None), ("b", 100.0)], "k string, x double")
    got = {r["k"]: r for r in studies.posterior_interval(df, "k", "x").collect()}
    assert got["a"]["mean"] == pytest.approx(57) and got["a"]["sd"] == pytest.approx(180**0.5)
    assert got["b"]["high"] <= 100 and got["b"]["mean"] == pytest.approx((57 / 180 + 100 / 120) / (1 / 180 + 1 / 120))


def test_seasonal_var_equals_dummies(spark):
    rng = np.random.default_rng(8)
    n, y = 150, np.zeros((150, 2))
    ds = days(n)
    for t in range(2, n):
        y[t] = np.array([[0.5, 0.2], [0.0, 0.4]]) @ y[t - 1] + np.array([[-0.4, 0], [0, 0.3]]) @ y[t - 2] + ds[t].month + rng.normal(size=2)
    df = spark.createDataFrame([("s", d, *map(float, v)) for d, v in zip(ds, y, strict=True)], "k string, d date, a double, b double")
    fit = studies.seasonal_var(df, "k", "d", ["a", "b"], F.month("d"), lags=2)
    x = np.column_stack([y[1:-1], y[:-2], *[[d.month == m for d in ds[2:]] for m in range(1, 13)]]).astype(float)
    want = np.linalg.lstsq(x, y[2:], rcond=None)[0][:4].T
    assert fit["coef"] == pytest.approx(want, abs=1e-8)
    assert 2 <= studies.seasonal_var(df, "k", "d", ["a", "b"], F.month("d"), most=5)["lags"] <= 5


def test_stored_model_scores_alike(spark, tmp_path):
    df = spark.createDataFrame([(float(k), 3.0 + 2.0 * k) for k in range(8)] + [(None, 1.0)], "x double, y double")
    studies.save_linear(spark, linear.ols(df.dropna(), "y", ["x"]), ["x"], str(tmp_path / "m"))
    got = studies.score_saved(df, str(tmp_path / "m")).collect()
    assert all(r["score"] is None if r["x"] is None else r["score"] == pytest.approx(r["y"]) for r in got)


def test_lagged_design_and_study(spark):
    df = spark.createDataFrame([("a", d, float(k), float(-k)) for k, d in enumerate(days(3))], "k string, d date, s double, y double")
    got = studies.lagged_design(df, "k", "d", ["s"], "y").orderBy("d").collect()
    assert [(r["y"], r["s_lag"], r["y_lag"]) for r in got] == [(0.0, None, None), (-1.0, 0.0, 0.0), (-2.0, 1.0, -1.0)]
    long = studies.study({"p": df.groupBy("k").agg(F.count("*").alias("n"), F.max("s").alias("top"))}, "k")
    assert sorted((r["part"], r["measure"], r["value"]) for r in long.collect()) == [("p", "n", 3.0), ("p", "top", 2.0)]
