"""Simulation, resampling and series models, in parallel over paths, replicates or series."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from .folds import grouped, known
from .optimize import nelder_mead

Z95 = 1.6448536269514722


def closed_form_fan(params: DataFrame, key: str, steps: int, yearly: float = 252.0) -> DataFrame:
    """``key, step, q05, q50, q95`` of geometric Brownian motion, from ``key, start, mu, sigma`` (yearly)."""
    t = F.col("step") / yearly
    q = lambda z: F.col("start") * F.exp((F.col("mu") - F.col("sigma") ** 2 / 2) * t + z * F.col("sigma") * F.sqrt(t))
    each = params.select(key, "start", "mu", "sigma", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return each.select(key, "step", q(-Z95).alias("q05"), q(0.0).alias("q50"), q(Z95).alias("q95"))


def _paths(params: DataFrame, key: str, names: list[str], paths: int, steps: int, seed: int, chunk: int, draw) -> DataFrame:
    """``key, path, step, value`` of antithetic pairs for each row of parameters; rows are dealt to tasks in chunks of pairs.

    A chunk's generator depends on the seed, the key and the chunk's number only. Rows with a null parameter have no paths.
    """
    pairs = paths // 2
    d = params.select(F.col(key).cast("string").alias("_key"), *[F.col(n).cast("double") for n in names]).dropna()
    d = d.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-pairs // chunk) - 1)))).repartition("_key", "_chunk")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n = min(chunk, pairs - row[-1] * chunk)
                values = draw(np.random.default_rng((seed, zlib.crc32(row[0].encode()), int(row[-1]))), n, dict(zip(names, row[1:-1], strict=True)))
                path = np.repeat(np.arange(2 * n) + 2 * row[-1] * chunk, steps + 1)
                yield pd.DataFrame({"_key": row[0], "path": path, "step": np.tile(np.arange(steps + 1), 2 * n).astype(np.int32), "value": values.ravel()})

    return d.mapInPandas(run, "_key string, path long, step int, value double").withColumnRenamed("_key", key)


def gbm_paths(params: DataFrame, key: str, paths: int, steps: int, seed: int, yearly: float = 252.0, chunk: int = 500) -> DataFrame:
    """Geometric Brownian motion from ``start, mu, sigma``."""

    def draw(rng, n, p):
        z = rng.standard_normal((n, steps))
        z = np.concatenate([z, -z]) * p["sigma"] / math.sqrt(yearly) + (p["mu"] - p["sigma"] ** 2 / 2) / yearly
        return p["start"] * np.exp(np.concatenate([np.zeros((2 * n, 1)), np.cumsum(z, axis=1)], axis=1))

    return _paths(params, key, ["start", "mu", "sigma"], paths, steps, seed, chunk, draw)


def heston_paths(params: DataFrame, key: str, paths: int, steps: int, seed: int, yearly: float = 252.0, chunk: int = 500) -> DataFrame:
    """Stochastic variance by full truncation, from ``start, mu, v0, kappa, theta, xi, rho``."""

    def draw(rng, n, p):
        dt = 1 / yearly
        z1, z2 = rng.standard_normal((2, n, steps))
        z1, z2 = np.concatenate([z1, -z1]), np.concatenate([z2, -z2])
        z2 = p["rho"] * z1 + math.sqrt(1 - p["rho"] ** 2) * z2
        v, x = np.full(2 * n, p["v0"]), np.full((2 * n, steps + 1), math.log(p["start"]))
        for k in range(steps):
            up = np.maximum(v, 0)
            x[:, k + 1] = x[:, k] + (p["mu"] - up / 2) * dt + np.sqrt(up * dt) * z1[:, k]
            v = v + p["kappa"] * (p["theta"] - up) * dt + p["xi"] * np.sqrt(up * dt) * z2[:, k]
        return np.exp(x)

    return _paths(params, key, ["start", "mu", "v0", "kappa", "theta", "xi", "rho"], paths, steps, seed, chunk, draw)


def mean_reverting_paths(params: DataFrame, key: str, paths: int, steps: int, seed: int, root: bool = False, yearly: float = 252.0, chunk: int = 500) -> DataFrame:
    """Vasicek, or with ``root`` the square-root process truncated at zero, from ``start, kappa, mean, sigma``."""

    def draw(rng, n, p):
        z = rng.standard_normal((n, steps))
        z, dt = np.concatenate([z, -z]), 1 / yearly
        x = np.full((2 * n, steps + 1), p["start"])
        for k in range(steps):
            scale = p["sigma"] * np.sqrt(np.maximum(x[:, k], 0)) if root else p["sigma"]
            x[:, k + 1] = x[:, k] + p["kappa"] * (p["mean"] - x[:, k]) * dt + scale * math.sqrt(dt) * z[:, k]
        return x

    return _paths(params, key, ["start", "kappa", "mean", "sigma"], paths, steps, seed, chunk, draw)


def path_summary(paths: DataFrame, key: str) -> DataFrame:
    qs = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    return paths.groupBy(key, "step").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), *[F.percentile("value", F.lit(q)).alias(k) for k, q in qs.items()])


def desk_metrics(paths: DataFrame, key: str, barrier: float, level: float, dv01: float = 1.0) -> DataFrame:
    """A key's chance to touch ``barrier`` times the start, and value at risk and expected shortfall of the last step's change."""
    last = paths.groupBy(key, "path").agg(F.max("value").alias("hi"), F.max_by("value", "step").alias("end"), F.min_by("value", "step").alias("start"))
    last = last.withColumn("pnl", -(F.col("end") - F.col("start")) * 100 * dv01)
    var = last.groupBy(key).agg(F.percentile("pnl", F.lit(1 - level)).alias("var"))
    touch = F.avg((F.col("hi") >= barrier * F.col("start")).cast("double"))
    return last.join(var, key).groupBy(key).agg(touch.alias("touch"), F.first("var").alias("var"), F.avg(F.when(F.col("pnl") <= F.col("var"), F.col("pnl"))).alias("shortfall"))


def mean_reversion(df: DataFrame, key: str, order: str, x: str, yearly: float) -> DataFrame:
    """``kappa, mean, sigma`` from the regression of changes on levels."""
    b = F.lag(x).over(W.by(key, order))
    d = df.select(key, (F.col(x) - b).alias("_d"), b.alias("_b")).dropna()
    slope, cut = F.regr_slope("_d", "_b"), F.regr_intercept("_d", "_b")
    ssr = F.regr_syy("_d", "_b") * (1 - F.regr_r2("_d", "_b"))
    return d.groupBy(key).agg((-slope * yearly).alias("kappa"), (-cut / slope).alias("mean"), (F.sqrt(ssr / (F.count("*") - 2)) * F.sqrt(F.lit(yearly))).alias("sigma"))


def drift_and_volatility(df: DataFrame, key: str, order: str, x: str, last: int, yearly: float) -> DataFrame:
    w = W.by(key, order)
    d = df.select(key, order, (F.log(x) - F.lag(F.log(x)).over(w)).alias("_g"), F.row_number().over(W.by(key, F.desc(order))).alias("_k")).where((F.col("_k") <= last) & F.col("_g").isNotNull())
    return d.groupBy(key).agg((F.avg("_g") * yearly + F.var_samp("_g") * yearly / 2).alias("mu"), (F.stddev_samp("_g") * F.sqrt(F.lit(yearly))).alias("sigma"))


def arma_residuals(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Conditional residuals, before the start all zero."""
    e = np.zeros(len(x))
    for t in range(len(x)):
        e[t] = x[t] - sum(a * x[t - 1 - k] for k, a in enumerate(ar) if t > k) - sum(b * e[t - 1 - k] for k, b in enumerate(ma) if t > k)
    return e


def arma_fit(x: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Conditional least squares; returns AR, MA and the AIC."""
    f = lambda c: float((arma_residuals(x, c[:p], c[p:]) ** 2).sum()) if np.abs(c).max(initial=0) < 3 else 1e300
    c = nelder_mead(f, np.full(p + q, 0.1), steps=120) if p + q else np.zeros(0)
    n = len(x)
    return c[:p], c[p:], n * math.log(max(f(c), 1e-300) / n) + 2 * (p + q + 1)


def hamilton(x: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Filtered chance of the high-variance regime of two, by EM."""
    v = np.var(x) or 1.0
    var, mean, stay = np.array([0.5 * v, 2 * v]), np.array([x.mean()] * 2), np.array([0.95, 0.95])
    for _ in range(rounds):
        like = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * math.pi * var) + 1e-300
        move = np.array([[stay[0], 1 - stay[0]], [1 - stay[1], stay[1]]])
        f, ahead = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        p = np.array([0.5, 0.5])
        for t in range(len(x)):
            ahead[t] = p @ move
            f[t] = ahead[t] * like[t] / (ahead[t] @ like[t])
            p = f[t]
        s, pair = f.copy(), np.zeros((2, 2))
        for t in range(len(x) - 2, -1, -1):
            joint = f[t][:, None] * move * (s[t + 1] / ahead[t + 1])[None, :]
            pair += joint
            s[t] = joint.sum(axis=1)
        w = s.sum(axis=0)
        mean = (s * x[:, None]).sum(axis=0) / w
        new = np.maximum((s * (x[:, None] - mean) ** 2).sum(axis=0) / w, 1e-6 * v)
        stay = np.clip(np.diag(pair) / pair.sum(axis=1), 0.5, 0.999)
        done, var = np.abs(new - var).max() < 1e-8 * v, new
        if done:
            break
    return f[:, int(np.argmax(var))]


def regimes(df: DataFrame, key: str, order: str, x: str) -> DataFrame:
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        v, at = known(pdf[x])
        out = np.full(len(v), np.nan)
        if at.sum() > 10:
            out[at] = hamilton(v[at])
        return pdf.assign(p_high=out)

    return grouped(df, key, order, {"p_high": "double"}, f)


def garch(df: DataFrame, key: str, order: str, ret: str) -> DataFrame:
    """GARCH(1,1) by likelihood: ``omega, alpha, beta`` and the long-run deviation, one row a key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[ret].dropna().to_numpy(float)
        x = x - x.mean() if len(x) else x
        v = float(np.var(x)) if len(x) > 10 else 0.0
        if v <= 0:
            return pd.DataFrame({key: [pdf[key].iloc[0]], "omega": [np.nan], "alpha": [np.nan], "beta": [np.nan], "long_run": [np.nan]})

        def parts(p):
            a, b = 1 / (1 + math.exp(-p[0])), 1 / (1 + math.exp(-p[1]))
            return 0.999 * a * (1 - b), 0.999 * a * b

        def loss(p):
            alpha, beta = parts(np.clip(p, -30, 30))
            omega, h, total = v * (1 - alpha - beta), v, 0.0
            for e in x:
                total += math.log(h) + e * e / h
                h = omega + alpha * e * e + beta * h
            return total

        alpha, beta = parts(np.clip(nelder_mead(loss, [2.0, 2.0], steps=100), -30, 30))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "omega": [v * (1 - alpha - beta)], "alpha": [alpha], "beta": [beta], "long_run": [math.sqrt(v)]})

    return df.groupBy(key).applyInPandas(run, f"{key} string, omega double, alpha double, beta double, long_run double")
