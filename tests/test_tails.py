"""Tail bands against plain loops, a likelihood search and their own law."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from tidalframe.operators import tails
from tidalframe.operators.optimize import nelder_mead


def pareto(rng, shape, scale, n):
    u = rng.random(n)
    return scale * -np.log(u) if shape == 0 else scale / shape * (u**-shape - 1)


def log_likelihood(x, shape, scale):
    inside = 1 + shape * x / scale
    if scale <= 0 or inside.min() <= 0 or shape <= -0.5:
        return -math.inf
    return -len(x) * math.log(scale) - (np.log(inside).sum() * (1 / shape + 1) if abs(shape) > 1e-9 else x.sum() / scale)


@pytest.mark.parametrize("shape", [-0.3, 0.0, 0.2, 0.7])
def test_pareto_fit_maximises_the_likelihood(shape):
    rng = np.random.default_rng(int(shape * 10) + 9)
    rows = np.full((6, 400), np.nan)
    for k, n in enumerate((12, 20, 60, 150, 300, 400)):
        rows[k, :n] = pareto(rng, shape, 2.5, n)
    got_shape, got_scale = tails.pareto_fit(rows)
    for x, c, s in zip(rows, got_shape, got_scale, strict=True):
        x = x[np.isfinite(x)]
        best = max((nelder_mead(lambda p: -log_likelihood(x, p[0], math.exp(p[1])) if p[1] < 50 else math.inf, [c0, math.log(x.mean())]) for c0 in (-0.2, 0.1, 0.5)), key=lambda p: log_likelihood(x, p[0], math.exp(p[1])))
        if best[0] < -0.45:  # at the bound of the shape
            assert c < -0.3
            continue
        assert log_likelihood(x, c, s) >= log_likelihood(x, best[0], math.exp(best[1])) - 1e-6
    assert abs(got_shape[-1] - shape) < 0.2


def plain_quantile(x, q, tail):
    x = np.asarray([v for v in x if np.isfinite(v)])
    if len(x) < 3:
        return math.nan
    if tail == "kde" and x.std() > 0:
        h = x.std(ddof=1) * len(x) ** (-1 / 5)
        grid = np.linspace(x.min(), x.max(), 512)
        mass = np.cumsum([np.exp(-0.5 * ((g - x) / h) ** 2).mean() for g in grid])
        return float(np.interp(q, mass / mass[-1], grid))
    if tail == "gpd" and not 0.1 < q < 0.9 and len(x) >= 20:
        y, p = (x, q) if q >= 0.5 else (-x, 1 - q)
        u = np.quantile(y, 0.9)
        over = y[y > u] - u
        if len(over) >= 12:
            c, s = (float(v[0]) for v in tails.pareto_fit(over[None, :]))
            left = len(x) / len(over) * (1 - p)
            v = u + (s / c * (left**-c - 1) if abs(c) > 1e-6 else -s * math.log(left))
            return v if q >= 0.5 else -v
    return float(np.quantile(x, q))


@pytest.mark.parametrize("tail", tails.TAILS)
def test_window_quantiles_one_by_one(tail):
    rng = np.random.default_rng(3)
    rows = [rng.standard_t(3, n) for n in (1, 2, 3, 19, 20, 50, 119, 130, 200, 200)] + [np.ones(150), np.repeat([1.0, 2.0], 80)]
    size = max(map(len, rows))
    x = np.stack([np.concatenate([r, np.full(size - len(r), np.nan)]) for r in rows])
    levels = (0.01, 0.1, 0.5, 0.9, 0.99)
    np.testing.assert_allclose(tails.window_quantiles(x, levels, tail), [[plain_quantile(r, q, tail) for q in levels] for r in rows], rtol=1e-7)
    with pytest.raises(ValueError):
        tails.window_quantiles(x, levels, "normal")


def series(spark, n=320):
    rng = np.random.default_rng(5)
    day = dt.date(2000, 1, 7)
    rows = [(k, day + dt.timedelta(weeks=i), None if i % 9 == 4 else float(v)) for k in ("a", "b") for i, v in enumerate(rng.standard_t(4, n))]
    rows += [("short", day + dt.timedelta(weeks=i), float(i)) for i in range(8)] + [("nan", day, float("nan")), ("none", day, None)]
    return rows, spark.createDataFrame(rows, "k string, d date, v double").repartition(3)


@pytest.mark.parametrize(("tail", "step"), [("gpd", 1), ("kde", 7), ("empirical", 3)])
def test_rolling_bands_and_causality(spark, tail, step):
    rows, df = series(spark)
    levels = (0.05, 0.95)
    run = lambda d: {(r.k, r.d): (r["q0.05"], r["q0.95"]) for r in tails.rolling_bands(d, "k", "d", "v", window=180, tail=tail, levels=levels, step=step).collect()}
    got, want = run(df), {}
    for k in ("a", "b", "short"):
        known = [(d, v) for n, d, v in rows if n == k and v is not None]
        last = (None, None)
        for i, (d, _) in enumerate(known):
            if i >= 90 and (i - 90) % step == 0:
                last = tuple(plain_quantile([v for _, v in known[max(0, i - 179) : i + 1]], q, tail) for q in levels)
            want[(k, d)] = last
    assert got.keys() == want.keys()
    for at, pair in want.items():
        assert got[at] == pair if pair[0] is None else got[at] == pytest.approx(pair, rel=1e-7)
    early = run(df.where("d < '2004-06-01'"))
    for at, pair in early.items():
        assert pair == (got[at] if pair[0] is None else pytest.approx(got[at], rel=1e-7))


def test_resampled_bands(spark):
    rows, df = series(spark)
    run = lambda d, **o: {(r.k, r.level): r for r in tails.resampled_bands(d, "k", "d", "v", window=150, draws=230, chunk=50, **o).collect()}
    got = run(df)
    for k in ("a", "b"):
        x = [v for n, _, v in rows if n == k and v is not None][-150:]
        for q in tails.LEVELS:
            r = got[(k, q)]
            assert r.n == 150 and r.point == pytest.approx(plain_quantile(x, q, "gpd")) and r.low <= r.high
    assert got[("short", 0.95)].point is None and got[("short", 0.95)].n == 8 and ("none", 0.95) not in got
    other = run(df.repartition(7))
    assert other.keys() == got.keys() and all(other[k].high == (r.high if r.high is None else pytest.approx(r.high, rel=1e-7)) for k, r in got.items())
    assert run(df, seed=1)[("a", 0.95)].high != pytest.approx(got[("a", 0.95)].high, rel=1e-7)
    assert tails.resampled_bands(df.limit(0), "k", "d", "v").count() == 0


def test_coverage(spark):
    rows, df = series(spark)
    bands = tails.rolling_bands(df, "k", "d", "v", window=104, tail="empirical")
    held = [r for r in bands.collect() if r["q0.95"] is not None and r.k == "a"]
    rate = sum(r.v > r["q0.95"] for r in held) / len(held)
    got = {(r.k, r.level): r for r in tails.coverage(bands, "k", "v").collect()}
    assert got[("a", 0.95)].n == len(held) and got[("a", 0.95)].breach_rate == pytest.approx(rate)
    assert got[("a", 0.95)].well_calibrated == (0.025 <= rate <= 0.1) and ("short", 0.95) not in got
