"""Resampled tests against loops and exact enumeration; calibrated folds against a plain fit."""

from __future__ import annotations

import datetime as dt
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.operators import calibrated, resampling

DAY = dt.date(2010, 1, 1)


def test_roll_leak_by_all_choices(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, n, on in (("few", 9, {2, 5}), ("leak", 12, {3, 7, 9}), ("none", 8, set()), ("all", 4, {0, 1, 2, 3}), ("many", 400, set(range(0, 400, 40)))):
        r = rng.normal(size=n) * 0.01
        if k == "leak":
            r[list(on)] *= 50
        rows += [(k, DAY + dt.timedelta(days=i), float(v) if i != 8 else None, i in on) for i, v in enumerate(r)]
    df = spark.createDataFrame(rows, "k string, d date, r double, roll boolean").repartition(3)
    run = lambda d, **o: {r.k: r for r in resampling.roll_leak_test(d, "k", "d", "r", F.col("roll"), **o).collect()}
    got = run(df)
    assert set(got) == {"few", "leak", "many"} and got["leak"].leak and not got["few"].leak
    for k in ("few", "leak"):
        on, off = ([abs(r) for n, _, r, x in rows if n == k and r is not None and x == want] for want in (True, False))
        means = [np.mean(c) for c in combinations(off, len(on))]
        assert got[k].p == pytest.approx(np.mean([m >= np.mean(on) * (1 - 1e-12) for m in means])) and got[k].random == pytest.approx(np.mean(means)) and (got[k].rolls, got[k].others) == (len(on), len(off))
    again = run(df.repartition(7))
    assert again["many"].p == got["many"].p and run(df, permutations=500, seed=4)["many"].p == pytest.approx(got["many"].p, abs=0.08)


def test_bootstrap_and_surrogates(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in ("a", "b"):
        x = np.cumsum(rng.normal(size=200))
        y = x + rng.normal(size=200) * 0.2 if k == "a" else rng.normal(size=200)
        rows += [(k, i, float(u), float(v)) for i, (u, v) in enumerate(zip(x, y, strict=True))] + [(k, 999, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, x double, y double").repartition(5)
    got = {r.k: r for r in resampling.block_bootstrap(df, "k", "i", "x", block=10, replicates=400).collect()}
    x = [r[2] for r in rows if r[0] == "a" and r[2] is not None]
    assert got["a"].n == 400 and got["a"].low < np.mean(x) < got["a"].high
    test = {r.k: r for r in resampling.surrogate_test(df, "k", "i", "x", "y").collect()}
    assert test["a"].corr == pytest.approx(np.corrcoef(x, [r[3] for r in rows if r[0] == "a"][:200])[0, 1]) and test["a"].p < 0.05 < test["b"].p
    assert {r.k: r.p for r in resampling.surrogate_test(df.repartition(2), "k", "i", "x", "y").collect()} == {k: r.p for k, r in test.items()}
    assert resampling.block_bootstrap(df.limit(0), "k", "i", "x", block=3, replicates=5).count() == 0


def test_too_long_a_series_raises(spark, monkeypatch):
    monkeypatch.setattr(resampling, "MOST_ROWS", 10)
    df = spark.range(11).select(F.lit("a").alias("k"), "id", F.col("id").cast("double").alias("x"))
    with pytest.raises(Exception, match="more than 10 rows"):
        resampling.held(df, "k", "id", "x").collect()


def descent(z, t, pen, steps=60):
    """Plain Newton steps."""
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(pen) + 1e-12 * np.eye(len(b)), z.T @ (t - p) - pen * b)
    return b


def test_platt_and_parts():
    rng = np.random.default_rng(3)
    t = (rng.random(40) < 0.4).astype(float)
    part = calibrated.stratified(t)
    for c in (0, 1):
        own = part[t == c]
        assert (np.diff(own) >= 0).all() and np.bincount(own, minlength=3).max() - np.bincount(own, minlength=3).min() <= 1
    score = t * 2 + rng.normal(size=40)
    a, b = calibrated.platt(score, t)
    target = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (40 - t.sum() + 2))
    loss = lambda a, b: -(target * np.log(1 / (1 + np.exp(a * score + b))) + (1 - target) * np.log(1 - 1 / (1 + np.exp(a * score + b)))).sum()
    assert a < 0
    for h in (1e-4, -1e-4):
        assert loss(a + h, b) > loss(a, b) and loss(a, b + h) > loss(a, b)


def test_walk_forward_as_a_loop(spark):
    rng, rows = np.random.default_rng(4), []
    for k in ("a", "b"):
        for i in range(150):
            x = rng.normal(size=2)
            rows.append((k, DAY + dt.timedelta(weeks=i), int(x[0] + rng.normal() > 0) if i % 31 else None, float(x[0]), float(x[1])))
    rows += [("one", DAY + dt.timedelta(weeks=i), 1, 0.0, float(i)) for i in range(100)] + [("short", DAY, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, d date, up int, u double, v double").repartition(4)
    found = calibrated.walk_forward(df, "k", "d", "up", ["u", "v"], least=60, step=13, embargo=5).cache()
    got = {(r.k, r.d): r.p for r in found.collect()}
    assert {k for k, _ in got} == {"a", "b"}
    known = sorted((r for r in rows if r[0] == "a" and r[2] is not None), key=lambda r: r[1])
    x, t, want = np.array([r[3:] for r in known]), np.array([r[2] for r in known], float), {}
    for first in range(60, len(known), 13):
        tx, tt = x[: first - 5], t[: first - 5]
        part, ps = calibrated.stratified(tt), []
        for j in range(3):
            b = descent(np.column_stack([np.ones((part != j).sum()), tx[part != j]]), tt[part != j], np.array([0, 2.0, 2.0]))
            s, y = b[0] + tx[part == j] @ b[1:], tt[part == j]
            target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
            c = descent(np.column_stack([np.ones(len(s)), s]), target, np.zeros(2))
            ps.append(1 / (1 + np.exp(-(c[0] + c[1] * (b[0] + x[first : first + 13] @ b[1:])))))
        want |= {known[first + i][1]: p for i, p in enumerate(np.mean(ps, 0))}
    assert {d: p for (k, d), p in got.items() if k == "a"} == pytest.approx(want, abs=1e-6)
    board = {r.k: r for r in calibrated.scores(found, "k", "up").collect()}
    p, y = np.array([got["a", r[1]] for r in known[60:]]), t[60:]
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert board["a"].n == len(p) and board["a"].auc == pytest.approx(np.mean(pairs)) and board["a"].brier == pytest.approx(((p - y) ** 2).mean())
    assert board["a"].log_loss == pytest.approx(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))) and board["a"].auc > 0.6
    early = {(r.k, r.d): r.p for r in calibrated.walk_forward(df.where("d < '2012-01-01'"), "k", "d", "up", ["u", "v"], least=60, step=13, embargo=5).collect()}
    assert early and all(got[k] == pytest.approx(p) for k, p in early.items())


def test_scores_with_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("a", 0.0, 0.5), ("a", 1.0, 1.0), ("a", 0.0, 0.0), ("b", 1.0, 0.3)], "k string, y double, p double")
    got = {r.k: r for r in calibrated.scores(df, "k", "y").collect()}
    assert got["a"].auc == pytest.approx((0.5 + 1 + 1 + 1) / 4) and got["b"].auc is None and math.isfinite(got["a"].log_loss)
