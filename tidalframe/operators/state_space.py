"""Latent factors by maximum likelihood: a Kalman filter and smoother for panels with gaps, and EM.

``y_t = load f_t + e_t`` with independent noise, ``f_t = lag_1 f_{t-1} + ... + u_t``
with unit shocks; the state holds ``order`` lags of the factors and begins at a
unit prior. Noise being diagonal, a row's elements update the state one by one:
gaps are skipped and no matrix of the columns' size is inverted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .folds import _null, grouped, known
from .latent import factor_filter

#: Rows of one series that a fit takes into a task; more raise an error.
MOST_ROWS = 200_000


@dataclass
class Factors:
    """``load`` (columns x factors), ``lag`` (factors x state), ``noise`` (columns)."""

    load: np.ndarray
    lag: np.ndarray
    noise: np.ndarray

    @property
    def move(self) -> np.ndarray:
        k, m = self.lag.shape
        return np.vstack([self.lag, np.eye(m - k, m)])

    @property
    def stable(self) -> bool:
        return bool(np.abs(np.linalg.eigvals(self.move)).max() < 1)


def run_filter(y: np.ndarray, f: Factors) -> dict:
    """``loglik``, predicted and filtered means and covariances, and of each row the squared surprise ``nis`` and its push along the first factor."""
    n, (k, m) = len(y), f.lag.shape
    load = np.zeros((y.shape[1], m))
    load[:, :k] = f.load
    move, shock = f.move, np.zeros((m, m))
    shock[range(k), range(k)] = 1.0
    mean, cov = np.zeros(m), np.eye(m)
    ahead, ahead_cov, now, now_cov = np.zeros((n, m)), np.zeros((n, m, m)), np.zeros((n, m)), np.zeros((n, m, m))
    nis, push, loglik = np.full(n, np.nan), np.full(n, np.nan), 0.0
    for t in range(n):
        mean, cov = move @ mean, move @ cov @ move.T + shock
        ahead[t], ahead_cov[t] = mean, cov
        seen = np.flatnonzero(np.isfinite(y[t]))
        if len(seen):
            gap = y[t, seen] - load[seen] @ mean
            push[t] = load[seen, 0] @ gap
            total = 0.0
            for i in seen:
                z = load[i]
                pz = cov @ z
                var = z @ pz + f.noise[i]
                e = y[t, i] - z @ mean
                mean = mean + pz * (e / var)
                cov = cov - np.outer(pz, pz) / var
                total += e * e / var
                loglik -= 0.5 * (math.log(2 * math.pi * var) + e * e / var)
            nis[t] = total
        now[t], now_cov[t] = mean, cov
    return {"loglik": loglik, "ahead": ahead, "ahead_cov": ahead_cov, "mean": now, "cov": now_cov, "nis": nis, "push": push}


def smooth(f: Factors, run: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and covariances given all rows, and the covariance of each state with the one before."""
    mean, cov = run["mean"].copy(), run["cov"].copy()
    lagged = np.zeros_like(cov)
    for t in range(len(mean) - 2, -1, -1):
        gain = run["cov"][t] @ f.move.T @ np.linalg.pinv(run["ahead_cov"][t + 1], hermitian=True)
        mean[t] += gain @ (mean[t + 1] - run["ahead"][t + 1])
        lagged[t + 1] = cov[t + 1] @ gain.T
        cov[t] += gain @ (cov[t + 1] - run["ahead_cov"][t + 1]) @ gain.T
    return mean, cov, lagged


def start(y: np.ndarray, factors: int, order: int) -> Factors:
    """Principal components of the complete rows and their own lags."""
    whole = y[np.isfinite(y).all(axis=1)]
    values, vectors = np.linalg.eigh(np.cov(whole.T, bias=True).reshape(y.shape[1], -1))
    load = vectors[:, ::-1][:, :factors]
    load = load * np.where(load[0] < 0, -1.0, 1.0)
    score = whole @ load
    scale = np.maximum(score.std(axis=0), 1e-6)
    lag = np.zeros((factors, factors * order))
    for k in range(factors):
        back = score[:-1, k] @ score[:-1, k]
        lag[k, k] = np.clip(score[1:, k] @ score[:-1, k] / back, -0.9, 0.9) if back > 0 else 0.0
    unit = np.sqrt(1 - np.diag(lag[:, :factors]) ** 2)
    noise = np.maximum((whole - score @ load.T).var(axis=0), 0.05)
    return Factors(load * scale * unit, lag, noise)


def em_round(y: np.ndarray, f: Factors, run: dict) -> Factors:
    """The parameters that maximise the expected likelihood given the smoothed states."""
    k = f.lag.shape[0]
    mean, cov, lagged = smooth(f, run)
    second = cov + mean[:, :, None] * mean[:, None, :]
    cross = (lagged[1:] + mean[1:, :, None] * mean[:-1, None, :])[:, :k].sum(axis=0)
    lag = np.linalg.solve(second[:-1].sum(axis=0).T + 1e-12 * np.eye(f.lag.shape[1]), cross.T).T
    load, noise = f.load.copy(), f.noise.copy()
    for i in range(y.shape[1]):
        seen = np.isfinite(y[:, i])
        if seen.sum() > k:
            v, s = y[seen, i], second[seen][:, :k, :k].sum(axis=0)
            load[i] = np.linalg.solve(s + 1e-12 * np.eye(k), mean[seen, :k].T @ v)
            noise[i] = max((v @ v - 2 * load[i] @ (mean[seen, :k].T @ v) + load[i] @ s @ load[i]) / seen.sum(), 1e-6)
    return Factors(load, lag, noise)


def fit(y: np.ndarray, factors: int = 1, order: int = 1, rounds: int = 200, tol: float = 1e-6) -> tuple[Factors, list[float], bool]:
    """EM until the likelihood gains less than ``tol`` of itself; the likelihood of each round; whether it converged (and is stable)."""
    f, path = start(y, factors, order), []
    for _ in range(rounds):
        run = run_filter(y, f)
        path.append(run["loglik"])
        if len(path) > 1 and path[-1] - path[-2] < tol * (1 + abs(path[-1])):
            return f, path, f.stable
        f = em_round(y, f, run)
    return f, path, False


def likelihood_factor(df: DataFrame, key: str, order: str, xs: list[str], *, factors: int = 1, lags: int = 1, train_end: str | None = None, least: int = 30, rounds: int = 200) -> DataFrame:
    """``factor, nis, deviation, loglik, converged`` a row: the first factor, filtered, and its signed surprise, both to unit deviation.

    Fitted on the rows up to ``train_end`` if ``least`` of them are known, else on
    all; without convergence on all. If that does not converge either, the fixed
    path of ``latent.factor_filter`` is used. The filter sees only the past. Rows
    may have gaps. A series with fewer than three complete rows or a constant
    column has nulls.
    """

    def unit(v: np.ndarray) -> np.ndarray:
        sd = np.nanstd(v) if np.isfinite(v).any() else 0.0
        return v / sd if sd > 0 else v

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_ROWS:
            raise ValueError(f"a series of more than {MOST_ROWS} rows: {pdf[key].iloc[0]}")
        z = np.column_stack([known(pdf[x])[0] for x in xs])
        whole = np.isfinite(z).all(axis=1)
        none = pdf.assign(factor=np.nan, nis=np.nan, deviation=np.nan, loglik=np.nan, converged=False)
        if whole.sum() < 3 or (z[whole].std(axis=0) == 0).any():
            return none
        z = (z - np.nanmean(z, axis=0)) / np.nanstd(z, axis=0)
        early = np.ones(len(z), bool) if train_end is None else (pd.to_datetime(pdf[order]) <= pd.Timestamp(train_end)).to_numpy()
        for rows in ([early] if (early & whole).sum() >= least and not early.all() else []) + [np.ones(len(z), bool)]:
            model, path, good = fit(z[rows], factors, lags, rounds)
            if good:
                break
        run = run_filter(z, model)
        state, nis, push = (run["mean"][:, 0], run["nis"], run["push"]) if good else factor_filter(z)
        sign = -1.0 if np.corrcoef(state[whole], z[whole, 0])[0, 1] < 0 else 1.0
        surprise = np.where(sign * push < 0, -1.0, 1.0) * np.sqrt(np.maximum(nis, 0))
        return pdf.assign(factor=unit(sign * (state - state.mean())), nis=nis, deviation=unit(surprise), loglik=run["loglik"] if good else np.nan, converged=good)

    outputs = {"factor": "double", "nis": "double", "deviation": "double", "loglik": "double", "converged": "boolean"}
    return _null(grouped(df.select(key, order, *xs), key, order, outputs, f), "factor", "nis", "deviation", "loglik")
