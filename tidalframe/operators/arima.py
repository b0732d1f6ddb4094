"""ARIMA(p, 1, q) by exact likelihood.

Changes of a series are an ARMA process in state space; its stationary start is
the prior, so the likelihood is that of the joint normal law, gaps included.
Coefficients are searched through partial autocorrelations, which keeps them
stationary and invertible; standard errors come from the likelihood's curvature.
Fits fan out over tasks by (series, model): a series is one recursion, of at
most ``MOST_ROWS`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .optimize import nelder_mead, normal_cdf
from .state_space import MOST_ROWS

#: Two-sided normal points of 80 and 95 percent.
POINTS = {80: 1.2815515655446004, 95: 1.959963984540054}


def from_partial(u: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from unbounded numbers, by way of partial autocorrelations."""
    out = np.zeros(0)
    for r in np.tanh(u):
        out = np.append(out - r * out[::-1], r)
    return out


def state_form(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition, shock loadings and the stationary covariance, in units of the shock variance."""
    m = max(len(ar), len(ma) + 1)
    move = np.zeros((m, m))
    move[: len(ar), 0] = ar
    move[range(m - 1), range(1, m)] = 1
    shock = np.concatenate([[1.0], ma, np.zeros(m - 1 - len(ma))])
    cov = np.linalg.solve(np.eye(m * m) - np.kron(move, move), np.outer(shock, shock).ravel()).reshape(m, m)
    return move, shock, cov


def innovations(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One-step errors and their relative variances (NaN at gaps), and the state's mean and covariance behind the last row.

    The first element of the state is observed without noise, so behind a value
    only the others' covariance is left: plain numbers instead of matrices. Once
    it has settled it is kept until a gap.
    """
    move, shock, start = state_form(ar, ma)
    m, wide = len(shock), np.outer(shock, shock)
    phi, w, cov, mean, settled = move[:, 0].tolist(), wide.tolist(), start.tolist(), [0.0] * m, False
    last = m - 1
    e, var, push = [], [], [0.0] * m
    for v in x.tolist():
        if v != v:
            e.append(math.nan), var.append(math.nan)
            mean, cov, settled = (move @ mean).tolist(), (move @ np.array(cov) @ move.T + wide).tolist(), False
            continue
        if not settled:
            f, top = cov[0][0], cov[0]
            # How an error moves the mean: the transition of the first column over its variance.
            push = [phi[i] + (cov[i + 1][0] / f if i < last else 0.0) for i in range(m)]
            after = [[w[i][j] + (cov[i + 1][j + 1] - cov[i + 1][0] * top[j + 1] / f if i < last and j < last else 0.0) for j in range(m)] for i in range(m)]
            settled = all(abs(after[i][j] - cov[i][j]) <= 1e-14 * f for i in range(m) for j in range(m))
            cov = after
        gap = v - mean[0]
        e.append(gap), var.append(f)
        mean = [phi[i] * mean[0] + (mean[i + 1] if i < last else 0.0) + push[i] * gap for i in range(m)]
    return np.array(e), np.array(var), np.array(mean), np.array(cov)


def log_likelihood(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[float, float]:
    """Exact log-likelihood at the best shock variance, and that variance."""
    e, var, _, _ = innovations(x, ar, ma)
    seen = np.isfinite(e)
    n = int(seen.sum())
    if n == 0:
        return -math.inf, math.nan
    s2 = max(float((e[seen] ** 2 / var[seen]).mean()), 1e-300)
    return -0.5 * (n * (math.log(2 * math.pi * s2) + 1) + float(np.log(var[seen]).sum())), s2


def fit(x: np.ndarray, p: int, q: int, z: np.ndarray | None = None, begin: np.ndarray | None = None) -> dict:
    """``ar, ma, beta, s2, loglik, aic, se, at``: maximum likelihood of an ARMA(p, q), with a regressor ``z`` if given.

    ``begin``: unbounded numbers ``at`` of an earlier fit to search from.
    """
    k = p + q + (z is not None)
    unpack = lambda u: (from_partial(u[:p]), -from_partial(u[p : p + q]), float(u[-1]) if z is not None else 0.0)

    def value(u: np.ndarray) -> float:
        if np.abs(u[: p + q]).max(initial=0) > 6:
            return 1e300
        ar, ma, beta = unpack(u)
        ll = log_likelihood(x if z is None else x - beta * z, ar, ma)[0]
        return -ll if math.isfinite(ll) else 1e300

    u = np.zeros(k)
    if k:
        if begin is None:
            begin = np.full(k, 0.1)
            if z is not None:
                both = np.isfinite(x) & np.isfinite(z)
                begin[-1] = float(x[both] @ z[both] / (z[both] @ z[both])) if (z[both] @ z[both]) > 0 else 0.0
        u = nelder_mead(value, begin, steps=60 * k, tol=1e-10)
        u = nelder_mead(value, u, steps=60 * k, size=0.1, tol=1e-10)
    ar, ma, beta = unpack(u) if k else (np.zeros(0), np.zeros(0), 0.0)
    ll, s2 = log_likelihood(x if z is None else x - beta * z, ar, ma)
    at = np.concatenate([ar, ma, [beta] if z is not None else []])
    natural = lambda c: log_likelihood(x if z is None else x - c[-1] * z, c[:p], c[p : p + q])[0]
    return {"ar": ar, "ma": ma, "beta": beta, "s2": s2, "loglik": ll, "aic": 2 * (k + 1) - 2 * ll, "se": errors(natural, at), "at": u}


def errors(value: Callable[[np.ndarray], float], at: np.ndarray) -> np.ndarray:
    """Standard errors from the second differences of a log-likelihood; NaN where it is not curved downwards."""
    k, h = len(at), 1e-4 * np.maximum(1e-2, np.abs(at))
    hess = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a, b = h[i] * np.eye(k)[i], h[j] * np.eye(k)[j]
            hess[i, j] = hess[j, i] = (value(at + a + b) - value(at + a - b) - value(at - a + b) + value(at - a - b)) / (4 * h[i] * h[j])
    if not np.isfinite(hess).all():
        return np.full(k, np.nan)
    var = np.diag(np.linalg.pinv(-hess)) if k else np.zeros(0)
    return np.sqrt(np.where(var > 0, var, np.nan))


def forecast(x: np.ndarray, last: float, model: dict, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations of the next levels."""
    _, _, mean, _ = innovations(x, model["ar"], model["ma"])
    move, shock, _ = state_form(model["ar"], model["ma"])
    changes, weights, state, push = [], [], mean, shock
    for _ in range(steps):
        changes.append(state[0])
        weights.append(push[0])
        state, push = move @ state, move @ push
    levels = np.cumsum(weights)  # of a shock, on the level
    return last + np.cumsum(changes), np.sqrt(model["s2"] * np.cumsum(levels**2))


def _series(pdf: pd.DataFrame, key: str, order: str, *xs: str) -> pd.DataFrame:
    d = pdf.dropna(subset=list(xs)).sort_values(order)
    if len(d) > MOST_ROWS:
        raise ValueError(f"a series of more than {MOST_ROWS} rows: {d[key].iloc[0]}")
    return d


def _fanned(df: DataFrame, models: list[tuple[int, int]]) -> DataFrame:
    return df.withColumn("_m", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in models]))).select("*", "_m.p", "_m.q").drop("_m")


GRID = ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (2, 1), (1, 2))


def fit_orders(df: DataFrame, key: str, order: str, x: str, grid=GRID, least: int = 20) -> DataFrame:
    """``key, p, q, n, loglik, aic, s2, coef, se, best``: each model of a series' changes; ``best`` has its series' least AIC. Series of fewer than ``least`` values are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = _series(pdf, key, order, x)
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        if len(d) < least:
            return pd.DataFrame(columns=["_key", "p", "q", "n", "loglik", "aic", "s2", "coef", "se"])
        m = fit(np.diff(d[x].to_numpy(float)), p, q)
        return pd.DataFrame([[d[key].iloc[0], p, q, len(d) - 1, m["loglik"], m["aic"], m["s2"], [*m["ar"], *m["ma"]], list(m["se"])]], columns=["_key", "p", "q", "n", "loglik", "aic", "s2", "coef", "se"])

    kind = df.schema[key].dataType.simpleString()
    out = _fanned(df.select(key, order, x), list(grid)).groupBy(key, "p", "q").applyInPandas(run, f"_key {kind}, p int, q int, n long, loglik double, aic double, s2 double, coef array<double>, se array<double>")
    least_aic = out.groupBy("_key").agg(F.min_by(F.struct("p", "q"), "aic").alias("_best"))
    return out.join(least_aic, "_key").select(F.col("_key").alias(key), "p", "q", "n", "loglik", "aic", "s2", "coef", "se", (F.struct("p", "q") == F.col("_best")).alias("best"))


def forecast_fan(df: DataFrame, key: str, order: str, x: str, p: int, q: int, steps: int = 21, least: int = 20) -> DataFrame:
    """``key, last, step, mean`` and bounds of 80 and 95 percent: forecasts behind each series' end, fitted to all of it."""
    bounds = [f"{side}{c}" for c in POINTS for side in ("low", "high")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = _series(pdf, key, order, x)
        if len(d) < least:
            return pd.DataFrame(columns=["_key", "last", "step", "mean", *bounds])
        v = d[x].to_numpy(float)
        mean, sd = forecast(np.diff(v), v[-1], fit(np.diff(v), p, q), steps)
        fan = {f"{side}{c}": mean + sign * z * sd for c, z in POINTS.items() for side, sign in (("low", -1), ("high", 1))}
        return pd.DataFrame({"_key": d[key].iloc[0], "last": d[order].iloc[-1], "step": np.arange(1, steps + 1), "mean": mean, **fan})

    kinds = f"_key {df.schema[key].dataType.simpleString()}, last {df.schema[order].dataType.simpleString()}, step int, mean double, {', '.join(f'{b} double' for b in bounds)}"
    return df.select(key, order, x).groupBy(key).applyInPandas(run, kinds).withColumnRenamed("_key", key)


def _rolled(v: np.ndarray, z: np.ndarray | None, p: int, q: int, split: int, refit: int) -> np.ndarray:
    """One-step forecasts of the levels from ``split`` on; refitted after the first row and each ``refit`` rows further."""
    d, dz = np.diff(v), None if z is None else np.diff(z)
    model = fit(d[: split - 1], p, q, None if dz is None else dz[: split - 1])
    out = []
    a = split
    while a < len(v):
        stop = a + 1 if a == split else min(len(v), a + refit)
        # The errors of a stretch come from one pass of the filter over all rows before its end.
        free = d[: stop - 1] if dz is None else d[: stop - 1] - model["beta"] * dz[: stop - 1]
        e, _, _, _ = innovations(free, model["ar"], model["ma"])
        out.extend(v[a:stop] - e[a - 1 : stop - 1])
        model = fit(d[: stop - 1], p, q, None if dz is None else dz[: stop - 1], model["at"]) if p + q or z is not None else model
        a = stop
    return np.array(out)


def forecast_scores(actual: np.ndarray, guess: np.ndarray, before: np.ndarray) -> dict:
    e, moved = guess - actual, actual != before
    hit = np.sign(guess - before) == np.sign(actual - before)
    return {"n": len(e), "rmse": float(np.sqrt((e**2).mean())), "mae": float(np.abs(e).mean()), "dir_acc": float(hit[moved].mean()) if moved.any() else math.nan}


def loss_test(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Diebold-Mariano statistic of squared one-step errors (below zero: ``a`` is better) and its two-sided p."""
    d = a**2 - b**2
    if len(d) < 10 or d.std() == 0:
        return math.nan, math.nan
    stat = float(d.mean() / (d.std() / math.sqrt(len(d))))
    return stat, 2 * (1 - normal_cdf(abs(stat)))


_SCORES = ["_key", "model", "n", "rmse", "mae", "dir_acc", "dm", "p_value", "skill"]
_KINDS = "model string, n long, rmse double, mae double, dir_acc double, dm double, p_value double, skill double"


def walk_forward(df: DataFrame, key: str, order: str, x: str, test: int, models=((1, 0), (0, 1), (1, 1)), refit: int = 21, least: int = 30) -> DataFrame:
    """One-step forecasts of each series' last ``test`` values by each model and the random walk ``(0, 0)``: errors, hits of direction, loss test and error ratio against the walk.

    A series shorter than ``test + 250`` is tested on its second half, as one of fewer than ``least`` values is not at all.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = _series(pdf, key, order, x)
        p, q, n = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0]), len(d)
        if n < least:
            return pd.DataFrame(columns=_SCORES)
        v = d[x].to_numpy(float)
        split = n - test if n - test >= 250 else n // 2
        actual, before = v[split:], v[split - 1 : -1]
        guess = _rolled(v, None, p, q, split, refit) if p + q else before
        s = forecast_scores(actual, guess, before)
        dm, pv = loss_test(guess - actual, before - actual) if p + q else (math.nan, math.nan)
        walk = float(np.sqrt(((before - actual) ** 2).mean()))
        return pd.DataFrame([[d[key].iloc[0], f"arima{p}1{q}" if p + q else "rw", *s.values(), dm, pv, s["rmse"] / walk if walk > 0 else math.nan]], columns=_SCORES)

    return _scored(_fanned(df.select(key, order, x), [(0, 0), *models]).groupBy(key, "p", "q").applyInPandas(run, f"_key {df.schema[key].dataType.simpleString()}, {_KINDS}"), key)


def exogenous_bridge(df: DataFrame, key: str, order: str, y: str, z: str, p: int = 1, q: int = 1, share: float = 0.35, refit: int = 8, least: int = 30) -> DataFrame:
    """One-step forecasts of ``y`` over the last ``share`` of a series' complete rows, with and without the regressor ``z``, known on the day; each model is a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = _series(pdf, key, order, y, z)
        with_z, n = bool(pdf["p"].iloc[0]), len(d)
        if n < least:
            return pd.DataFrame(columns=_SCORES)
        v, split = d[y].to_numpy(float), int(n * (1 - share))
        plain = _rolled(v, None, p, q, split, refit)
        guess = _rolled(v, d[z].to_numpy(float), p, q, split, refit) if with_z else plain
        s = forecast_scores(v[split:], guess, v[split - 1 : -1])
        dm, pv = loss_test(guess - v[split:], plain - v[split:]) if with_z else (math.nan, math.nan)
        base = float(np.sqrt(((plain - v[split:]) ** 2).mean()))
        return pd.DataFrame([[d[key].iloc[0], "with" if with_z else "without", *s.values(), dm, pv, s["rmse"] / base if base > 0 else math.nan]], columns=_SCORES)

    return _scored(_fanned(df.select(key, order, y, z), [(1, 0), (0, 0)]).groupBy(key, "p", "q").applyInPandas(run, f"_key {df.schema[key].dataType.simpleString()}, {_KINDS}"), key)


def _scored(df: DataFrame, key: str) -> DataFrame:
    real: list[Column] = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("rmse", "mae", "dir_acc", "dm", "p_value", "skill")]
    return df.select(F.col("_key").alias(key), "model", "n", *real)
