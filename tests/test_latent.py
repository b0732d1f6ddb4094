"""Latent factor, breaks, blends, exogenous forecasts, gates and feed lifecycle on small inputs."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.operators import latent
from tidalframe.streaming import cadence

DAY = dt.date(2020, 1, 3)


def weeks(n):
    return [DAY + dt.timedelta(weeks=k) for k in range(n)]


def test_factor_filter_is_the_matrix_filter():
    rng = np.random.default_rng(1)
    state = np.zeros(60)
    for t in range(1, 60):
        state[t] = 0.8 * state[t - 1] + rng.normal()
    z = np.column_stack([state + rng.normal(size=60), -state + rng.normal(size=60), 0.5 * state + rng.normal(size=60)])
    z = (z - z.mean(0)) / z.std(0)
    z[20, 1] = np.nan
    got, nis, push = latent.factor_filter(z, 0.5)
    whole = np.isfinite(z).all(1)
    load = np.linalg.svd(z[whole] - z[whole].mean(0))[2][0]
    load *= np.sign(load[0])
    score = z[whole] @ load
    lag = score[1:] @ score[:-1] / (score[:-1] @ score[:-1])
    m, p = 0.0, 1 / (1 - lag**2)
    for t in range(60):
        m, p = lag * m, lag * lag * p + 1
        if whole[t]:
            e, cov = z[t] - load * m, p * np.outer(load, load) + 0.5 * np.eye(3)
            inv = np.linalg.inv(cov)
            assert nis[t] == pytest.approx(e @ inv @ e)
            assert push[t] == pytest.approx(load @ e)
            m, p = m + p * load @ inv @ e, p - p * load @ inv @ load * p
        assert got[t] == pytest.approx(m)
    assert np.isnan(nis[20])


def test_dynamic_factor_of_short_constant_and_empty_series(spark):
    rows = [("short", d, 1.0, 2.0) for d in weeks(2)] + [("flat", d, 3.0, float(k)) for k, d in enumerate(weeks(6))]
    df = spark.createDataFrame(rows, "k string, d date, a double, b double")
    got = latent.dynamic_factor(df, "k", "d", ["a", "b"])
    assert got.count() == 8 and got.where("factor is not null or nis is not null").count() == 0
    assert latent.dynamic_factor(df.limit(0), "k", "d", ["a", "b"]).count() == 0


def test_factor_is_causal_given_its_parameters():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(40, 2))
    a = latent.factor_filter(z)[0]
    assert np.isfinite(a).all() and a[0] != 0


def test_break_response(spark):
    rows = [("a", d, float(k % 3) + (10 if k >= 12 else 0)) for k, d in enumerate(weeks(30))] + [("b", d, 1.0) for d in weeks(5)] + [("b", weeks(6)[5], None)]
    df = spark.createDataFrame(rows, "k string, d date, x double")
    got = latent.break_response(df, "k", "d", "x", F.col("x") > 9)
    a = [r for r in got.where("k = 'a'").orderBy("d").collect()]
    post = np.array([float(k % 3) + 10 for k in range(12, 30)])
    assert {r["broke_at"] for r in a} == {weeks(13)[12]}
    assert [r["restated"] for r in a[:12]] == [r["x"] for r in a[:12]]
    assert [r["restated"] for r in a[12:]] == pytest.approx(list((post - np.median(post)) / post.std()))
    assert got.where("k = 'b' and broke_at is null").count() == 6
    # The burn-in keeps early chances from counting; few rows after a break change nothing.
    late = latent.break_response(df.where("k = 'a'"), "k", "d", "x", F.lit(False), F.when(F.col("d") <= weeks(8)[7], 1.0).when(F.col("d") >= weeks(26)[25], 1.0))
    assert late.where("restated <> x").count() == 0 and {r["broke_at"] for r in late.collect()} == {weeks(26)[25]}


def test_burn_in_and_blend_with_nulls(spark):
    rng = np.random.default_rng(2)
    x = [None if k % 11 == 5 else float(v) for k, v in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame([("a", d, v) for d, v in zip(weeks(120), x, strict=True)] + [("b", d, 7.0) for d in weeks(4)], "k string, d date, x double")
    z = latent.burn_in_z(df, "k", "d", "x")
    early = np.array([v for v in x if v is not None][:27])
    m = np.median(early)
    want = [None if v is None else (v - m) / (1.4826 * np.median(np.abs(early - m))) for v in x]
    got = [r["z"] for r in z.where("k = 'a'").orderBy("d").collect()]
    assert [v is None for v in got] == [v is None for v in want]
    assert [v for v in got if v is not None] == pytest.approx([v for v in want if v is not None])
    assert {r["z"] for r in z.where("k = 'b'").collect()} == {0.0}
    blend = latent.surprise_blend(z, "k", "d", "x", ["z"]).where("k = 'a'").orderBy("d").collect()
    assert all(abs(r["blend"]) <= 1 for r in blend if r["blend"] is not None)
    assert all(r["blend"] is None or r["blend"] == 0 or np.sign(r["blend"]) == np.sign(r["x"]) for r in blend if r["x"] is not None)


def test_exogenous_forecasts_use_the_driver(spark):
    rng = np.random.default_rng(5)
    z = np.cumsum(rng.normal(size=90))
    y = 2 * z + np.cumsum(rng.normal(size=90) * 0.1)
    df = spark.createDataFrame([("a", d, float(u), float(v)) for d, u, v in zip(weeks(90), y, z, strict=True)] + [("few", d, 1.0, 1.0) for d in weeks(9)], "k string, d date, y double, z double")
    got = latent.exogenous_walk_forward(df, "k", "d", "y", "z", refit=16).toPandas()
    assert len(got) == 90 - int(90 * 0.65) and set(got["k"]) == {"a"}
    assert ((got["y"] - got["forecast"]) ** 2).mean() < 0.05 * ((got["y"] - got["plain"]) ** 2).mean()


@pytest.mark.parametrize(
    ("values", "passes"),
    [((0.1, 0.01, 0.1, 4.0, None), True), ((0.1, 0.01, 0.1, -4.0, 0.2), True), ((0.1, 0.05, 0.1, 4.0, None), False), ((0.1, 0.01, 0.1, 3.0, None), False), ((0.1, 0.01, 0.1, 4.0, -0.1), False), ((None, 0.01, 0.1, 4.0, 0.1), False)],
)
def test_gate(spark, values, passes):
    df = spark.createDataFrame([values], "a double, p double, h double, t double, d double")
    assert df.select(latent.gate(*[F.col(c) for c in df.columns]).alias("pass")).first()["pass"] is passes


def test_failover_and_refreshes(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("u", t0 + dt.timedelta(seconds=s), src) for s, src in ((0, "b"), (1, "a"), (2, "b"), (4, "b"), (5, "b"), (6, "c"))] + [("v", t0, "c"), ("v", None, "a")]
    df = spark.createDataFrame(rows, "k string, ts timestamp, source string")
    got = cadence.failover(df, "k", "ts", "source", ["a", "b"], dt.timedelta(seconds=3)).orderBy("ts").collect()
    assert [(r["ts"] - t0).seconds for r in got] == [0, 1, 5]
    reads = cadence.refreshes(df, "k", "ts", dt.timedelta(seconds=4))
    assert [(r["ts"] - t0).seconds for r in reads.where("pulled").orderBy("k", "ts").collect()] == [0, 4, 0]
    assert reads.count() == 8


def test_feed_lifecycle(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    feed = spark.readStream.text(str(tmp_path / "in"))
    first = cadence.start(feed, "lifecycle", str(tmp_path / "out"), "0 seconds")
    assert cadence.start(feed, "lifecycle", str(tmp_path / "out")).id == first.id
    assert cadence.active(spark, "lifecycle") is not None
    assert cadence.stop(spark, "lifecycle") and not cadence.stop(spark, "lifecycle")
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 2
