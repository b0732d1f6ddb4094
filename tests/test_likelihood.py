"""Exact likelihoods against the dense normal density; EM rounds; recovery of parameters; forecasts and their spread."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from tidalframe.operators import arima, state_space
from tidalframe.operators.latent import factor_filter


def normal_density(v, cov):
    return -0.5 * (len(v) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + v @ np.linalg.solve(cov, v))


def arma_covariance(ar, ma, n):
    """From the weights of an infinite moving average."""
    weights = np.zeros(4000)
    for k in range(len(weights)):
        weights[k] = (1.0 if k == 0 else 0.0) + (ma[k - 1] if 0 < k <= len(ma) else 0.0) + sum(a * weights[k - 1 - j] for j, a in enumerate(ar) if k > j)
    auto = [weights[: len(weights) - h] @ weights[h:] for h in range(n)]
    return np.array([[auto[abs(i - j)] for j in range(n)] for i in range(n)])


@pytest.mark.parametrize(("ar", "ma"), [([], []), ([0.6], []), ([], [0.5]), ([], [-0.95]), ([0.5, -0.3], [0.4]), ([-0.7], [0.3, 0.2]), ([0.2, 0.1, 0.3], [])])
def test_arma_likelihood_is_the_joint_density(ar, ma):
    ar, ma, rng = np.array(ar), np.array(ma), np.random.default_rng(2)
    x = rng.normal(size=40)
    x[[7, 8, 30]] = np.nan
    seen = np.isfinite(x)
    cov = arma_covariance(ar, ma, 40)[np.ix_(seen, seen)]
    ll, s2 = arima.log_likelihood(x, ar, ma)
    assert s2 == pytest.approx(x[seen] @ np.linalg.solve(cov, x[seen]) / seen.sum(), rel=1e-8)
    assert ll == pytest.approx(normal_density(x[seen], s2 * cov), rel=1e-9)


def simulate(ar, ma, n, seed):
    rng = np.random.default_rng(seed)
    e, x = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(3, n + 200):
        x[t] = e[t] + sum(a * x[t - 1 - k] for k, a in enumerate(ar)) + sum(b * e[t - 1 - k] for k, b in enumerate(ma))
    return x[200:]


def test_fit_finds_the_top_and_its_width():
    x = simulate([0.6], [-0.3], 1500, 4)
    m = arima.fit(x, 1, 1)
    assert abs(m["ar"][0] - 0.6) < 0.15 and abs(m["ma"][0] + 0.3) < 0.2
    for k in (0, 1):
        for h in (1e-3, -1e-3):
            c = np.array([m["ar"][0], m["ma"][0]]) + h * np.eye(2)[k]
            assert arima.log_likelihood(x, c[:1], c[1:])[0] < m["loglik"]
    one = arima.fit(simulate([0.6], [], 1500, 5), 1, 0)
    assert one["se"][0] == pytest.approx(math.sqrt((1 - one["ar"][0] ** 2) / 1500), rel=0.03)
    z = np.random.default_rng(1).normal(size=1500)
    both = arima.fit(x + 2.5 * z, 1, 1, z)
    assert both["beta"] == pytest.approx(2.5, abs=0.1) and both["aic"] == pytest.approx(8 - 2 * both["loglik"])


def test_forecast_and_its_spread():
    ar, ma = np.array([0.5]), np.array([0.3])
    x = simulate(ar, ma, 300, 6)
    m = {"ar": ar, "ma": ma, "s2": 2.0}
    mean, sd = arima.forecast(x, 10.0, m, 4)
    e = arima.innovations(x, ar, ma)[0]
    change, want = 0.5 * x[-1] + 0.3 * e[-1], 10.0
    for k in range(4):
        want += change
        assert mean[k] == pytest.approx(want)
        change *= 0.5
    psi = np.cumsum([1, 0.8, 0.4, 0.2])
    np.testing.assert_allclose(sd, np.sqrt(2.0 * np.cumsum(psi**2)))


def test_partial_autocorrelations_stay_inside():
    rng = np.random.default_rng(0)
    for _ in range(50):
        ar = arima.from_partial(rng.normal(size=3) * 2)
        assert (np.abs(np.roots([1, *-ar])) < 1).all()


def series(spark, n=160):
    day = dt.date(2001, 1, 5)
    rows = []
    for k, seed in (("a", 1), ("b", 2)):
        level, z = 50 + np.cumsum(simulate([], [-0.5], n, seed)), np.cumsum(np.random.default_rng(seed).normal(size=n))
        rows += [(k, day + dt.timedelta(weeks=i), None if i % 50 == 9 else float(v + 0.8 * w), float(w)) for i, (v, w) in enumerate(zip(level, z, strict=True))]
    rows += [("short", day + dt.timedelta(weeks=i), float(i % 3), 1.0) for i in range(6)]
    return spark.createDataFrame(rows, "k string, d date, y double, z double").repartition(3)


def test_models_of_series(spark):
    df = series(spark)
    got = arima.fit_orders(df, "k", "d", "y", ((0, 0), (0, 1), (1, 0))).collect()
    assert {(r.k, r.p, r.q) for r in got} == {(k, p, q) for k in "ab" for p, q in ((0, 0), (0, 1), (1, 0))}
    for k in "ab":
        mine = [r for r in got if r.k == k]
        assert [r.best for r in sorted(mine, key=lambda r: r.aic)] == [True, False, False]
    y = np.array([r.y for r in df.where("k = 'a' and y is not null").orderBy("d").collect()])
    ma1 = next(r for r in got if (r.k, r.p, r.q) == ("a", 0, 1))
    assert ma1.loglik == pytest.approx(arima.fit(np.diff(y), 0, 1)["loglik"]) and ma1.n == len(y) - 1 and len(ma1.coef) == len(ma1.se) == 1
    fan = arima.forecast_fan(df, "k", "d", "y", 0, 1, 5).where("k = 'a'").orderBy("step").collect()
    assert [r.step for r in fan] == [1, 2, 3, 4, 5] and all(r.low95 < r.low80 < r.mean < r.high80 < r.high95 for r in fan) and fan[0]["last"] == max(r.d for r in df.where("k = 'a' and y is not null").collect())
    assert arima.fit_orders(df.limit(0), "k", "d", "y").count() == 0


def test_walk_forward_sees_only_the_past(spark):
    df = series(spark)
    got = {(r.k, r.model): r for r in arima.walk_forward(df, "k", "d", "y", 50, ((0, 1),), refit=11).collect()}
    y = np.array([r.y for r in df.where("k = 'a' and y is not null").orderBy("d").collect()])
    split, guess, begin = len(y) // 2, [], None
    for i in range(split, len(y)):
        if i == split or (i - 1 - split) % 11 == 0:
            m = arima.fit(np.diff(y[:i]), 0, 1, begin=begin)
            begin = m["at"]
        guess.append(y[i - 1] + arima.forecast(np.diff(y[:i]), 0.0, m, 1)[0][0])
    e = np.array(guess) - y[split:]
    assert got[("a", "arima011")].rmse == pytest.approx(math.sqrt((e**2).mean()), rel=1e-6) and got[("a", "arima011")].n == len(e)
    assert got[("a", "rw")].rmse == pytest.approx(math.sqrt((np.diff(y)[split - 1 :] ** 2).mean())) and got[("a", "rw")].dm is None and not any(k == "short" for k, _ in got)


def test_bridge(spark):
    got = {(r.k, r.model): r for r in arima.exogenous_bridge(series(spark), "k", "d", "y", "z", 0, 1).collect()}
    for k in "ab":
        assert got[(k, "with")].rmse < got[(k, "without")].rmse and got[(k, "with")].dm < 0 and got[(k, "without")].skill == 1.0


# ---------------------------------------------------------------- factors


def made(n, p, k, order, seed, gaps=True):
    rng = np.random.default_rng(seed)
    f = np.zeros((n, k))
    for t in range(n):
        f[t] = (0.7 * f[t - 1] if t else 0) + (0.1 * f[t - 2] if t > 1 and order > 1 else 0) + rng.normal(size=k)
    y = f @ rng.normal(size=(k, p)) + rng.normal(size=(n, p)) * rng.uniform(0.3, 1.0, p)
    if gaps:
        y[rng.random((n, p)) < 0.1] = np.nan
    return (y - np.nanmean(y, 0)) / np.nanstd(y, 0)


@pytest.mark.parametrize(("k", "order"), [(1, 1), (1, 2), (2, 1), (2, 2)])
def test_factor_likelihood_is_the_joint_density(k, order):
    y = made(9, 4, k, order, 3)
    f = state_space.start(made(80, 4, k, order, 3, False), k, order)
    m = k * order
    move, shock, load = f.move, np.zeros((m, m)), np.zeros((4, m))
    shock[range(k), range(k)] = 1
    load[:, :k] = f.load
    n, cov = len(y), np.zeros((len(y) * 4, len(y) * 4))
    var, own = np.eye(m), []
    for _ in range(n):
        var = move @ var @ move.T + shock
        own.append(var)
    for s in range(n):
        for t in range(s, n):
            c = load @ np.linalg.matrix_power(move, t - s) @ own[s] @ load.T + (np.diag(f.noise) if s == t else 0)
            cov[4 * t : 4 * t + 4, 4 * s : 4 * s + 4], cov[4 * s : 4 * s + 4, 4 * t : 4 * t + 4] = c, c.T
    seen = np.isfinite(y.ravel())
    run = state_space.run_filter(y, f)
    assert run["loglik"] == pytest.approx(normal_density(y.ravel()[seen], cov[np.ix_(seen, seen)]))
    # Smoothed means are the conditional expectations.
    mean, _, _ = state_space.smooth(f, run)
    across = np.concatenate([load @ np.linalg.matrix_power(move, t - 2) @ own[2] if t >= 2 else (np.linalg.matrix_power(move, 2 - t) @ own[t] @ load.T).T for t in range(n)])[seen]
    np.testing.assert_allclose(mean[2], across.T @ np.linalg.solve(cov[np.ix_(seen, seen)], y.ravel()[seen]), atol=1e-8)


@pytest.mark.parametrize(("k", "order"), [(1, 1), (2, 2)])
def test_likelihood_rises_each_round(k, order):
    f, path, good = state_space.fit(made(150, 5, k, order, 7), k, order, rounds=60, tol=0)
    assert all(b >= a - 1e-6 for a, b in zip(path, path[1:], strict=False)) and path[-1] > path[0] + 1
    _, path, good = state_space.fit(made(150, 5, k, order, 7), k, order, rounds=2)
    assert not good and len(path) == 2


def test_factors_of_panels(spark):
    day, rows = dt.date(2000, 1, 7), []
    for key, seed in (("a", 1), ("b", 2)):
        y = made(90, 3, 1, 1, seed)
        rows += [(key, day + dt.timedelta(weeks=t), *[float(v) if np.isfinite(v) else None for v in r]) for t, r in enumerate(y)]
    rows += [("flat", day + dt.timedelta(weeks=t), 1.0, float(t), 2.0) for t in range(9)] + [("one", day, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, d date, u double, v double, w double").repartition(4)
    got = state_space.likelihood_factor(df, "k", "d", ["u", "v", "w"], train_end="2001-06-01").collect()
    for key in "ab":
        mine = sorted((r for r in got if r.k == key), key=lambda r: r.d)
        assert len(mine) == 90 and mine[0].converged and np.std([r.factor for r in mine]) == pytest.approx(1)
        whole = [r for r in mine if r.u is not None]
        assert np.corrcoef([r.factor for r in whole], [r.u for r in whole])[0, 1] > 0 and all(r.deviation * 0 == 0 for r in whole)
    assert all(r.factor is None and not r.converged for r in got if r.k in ("flat", "one"))
    # Without convergence: the fixed path.
    short = {r.d: r for r in state_space.likelihood_factor(df.where("k = 'a'"), "k", "d", ["u", "v", "w"], rounds=1).collect()}
    z = np.array([[np.nan if x is None else x for x in (short[d].u, short[d].v, short[d].w)] for d in sorted(short)])
    nis = factor_filter((z - np.nanmean(z, 0)) / np.nanstd(z, 0))[1]
    assert not any(r.converged for r in short.values())
    np.testing.assert_allclose([np.nan if short[d].nis is None else short[d].nis for d in sorted(short)], nis)
