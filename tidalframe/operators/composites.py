"""Composite indicators, lag-weighted features, decompositions and diagnostics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions import windows as W
from . import folds
from . import optimize as O
from .folds import grouped, known


def normalised(df: DataFrame, key: str, order: str, x: str, mode: str, out: str = "value_n") -> DataFrame:
    """One of ``raw, fracdiff, volscale, robust, ewma``."""
    w = W.by(key, order)
    if mode == "raw":
        return df.withColumn(out, F.col(x))
    if mode == "fracdiff":
        return df.withColumn(out, W.fractional_difference(x, w, 0.4, 10))
    if mode == "volscale":
        return folds.ewma_vol_scale(df, key, order, x, 26, out)
    if mode == "ewma":
        return folds.ewma_z(df, key, order, x, 26, out)
    if mode == "robust":
        return W.robust_z(df, x, out, w, 26)
    raise ValueError(f"unknown mode {mode}")


def blended(df: DataFrame, date: str, parts: dict[str, float], out: str = "composite") -> DataFrame:
    """Weighted mean of columns, weights of the known ones renormalised; null where none is known."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0))
    return df.withColumn(out, F.try_divide(value, F.when(total != 0, total)))


def lag_features(df: DataFrame, key: str, order: str, x: str, k: int) -> DataFrame:
    """Lag-weighted and rolling features of the last ``k`` known values; null unless there are ``k``."""
    from .relational import last_k

    d = last_k(df, [key], order, x, k)
    size, total = F.lit(float(k)), lambda e: F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    mean = total(F.col("lags")) / size
    var = total(F.transform("lags", lambda v: (v - mean) ** 2)) / (size - 1)
    cols = {
        "almon": scalars.weighted("lags", scalars.almon_weights(k, 0.1, -0.05)), "beta": scalars.weighted("lags", scalars.beta_weights(k, 1.5, 3.0)), "newest": F.col("lags")[0], "mean": mean, "sd": F.sqrt(var),
        "low": F.array_min("lags"), "high": F.array_max("lags"), "slope": scalars.lag_slope("lags", k), "moved": F.col("lags")[0] - F.col("lags")[k - 1],
    }
    return d.select(key, order, *[F.when(F.col("lags").isNotNull(), e).alias(n) for n, e in cols.items()])


def effective_number(df: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """Series, their mean pairwise correlation on common dates, and the independent bets that leaves."""
    a, b = df.select(F.col(key).alias("_a"), order, F.col(x).alias("_x")), df.select(F.col(key).alias("_b"), order, F.col(x).alias("_y"))
    c = pair_correlations(a, b, order).agg(F.avg("corr").alias("rho"))
    n = df.select(key).distinct().agg(F.count("*").alias("n"))
    j = n.join(F.broadcast(c))
    return j.select("n", "rho", F.try_divide(F.col("n"), 1 + (F.col("n") - 1) * F.col("rho")).alias("bets"))


def pair_correlations(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """``_a, _b, n, corr``: each pair of series over the dates that both have (pairs of series, not of rows)."""
    return a.join(b, order).where("_a < _b and _x is not null and _y is not null").groupBy("_a", "_b").agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("corr"))


def loess(y: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Local lines with tricube weights over the ``width`` nearest points."""
    n, out = len(y), np.empty(len(at))
    x = np.arange(n, dtype=float)
    for k, t in enumerate(at):
        d = np.abs(x - t)
        h = max(np.partition(d, min(width, n) - 1)[min(width, n) - 1], 1e-9) * (1 if width <= n else width / n)
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        s, sx, sy = w.sum(), (w * x).sum(), (w * y).sum()
        sxx, sxy = (w * x * x).sum(), (w * x * y).sum()
        det = s * sxx - sx * sx
        out[k] = (sy / s) if abs(det) < 1e-9 * s * s else ((sxx * sy - sx * sxy) + t * (s * sxy - sx * sy)) / det
    return out


def stl(y: np.ndarray, period: int = 12, season: int = 7, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend parts by alternating local regressions (full series, not causal)."""
    n, trend, seasonal = len(y), np.zeros(len(y)), np.zeros(len(y))
    width = 2 * ((int(1.5 * period / (1 - 1.5 / season)) + 1) // 2) + 1
    for _ in range(rounds):
        d = y - trend
        for k in range(period):
            part = d[k::period]
            if len(part):
                seasonal[k::period] = loess(part, np.arange(len(part), dtype=float), season)
        flat = pd.Series(seasonal).rolling(period, center=True, min_periods=1).mean().to_numpy()
        seasonal = seasonal - flat
        trend = loess(y - seasonal, np.arange(n, dtype=float), width)
    return seasonal, trend


def decompose(df: DataFrame, key: str, order: str, x: str, period: int = 12) -> DataFrame:
    """``seasonal, trend, residual, z``: the residual over its sample deviation."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        v, at = known(pdf[x])
        out = {c: np.full(len(v), np.nan) for c in ("seasonal", "trend", "residual", "z")}
        if at.sum() >= 2 * period:
            s, t = stl(v[at], period)
            e = v[at] - s - t
            sd = e.std(ddof=1)
            for c, values in (("seasonal", s), ("trend", t), ("residual", e), ("z", e / sd if sd > 0 else np.full(len(e), np.nan))):
                out[c][at] = values
        return pdf.assign(**out)

    cols = ["seasonal", "trend", "residual", "z"]
    return folds._null(grouped(df, key, order, {c: "double" for c in cols}, f), *cols)


def band_pass(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Christiano-Fitzgerald asymmetric filter of a random walk (full series, not causal)."""
    n = len(x)
    a, b = 2 * math.pi / high, 2 * math.pi / low
    j = np.arange(1, n)
    weights = np.concatenate([[(b - a) / math.pi], (np.sin(j * b) - np.sin(j * a)) / (math.pi * j)])
    x = x - np.linspace(x[0], x[-1], n) if n > 1 else x
    out = np.zeros(n)
    for t in range(n):
        ahead = -weights[0] / 2 - weights[1 : n - 1 - t].sum() if t < n - 1 else 0.0
        back = -weights[0] / 2 - weights[1:t].sum() if t > 0 else 0.0
        out[t] = weights[0] * x[t] + weights[1 : n - 1 - t] @ x[t + 1 : n - 1] + (ahead * x[-1] if t < n - 1 else 0) + (weights[1:t] @ x[t - 1 : 0 : -1] if t > 0 else 0.0) + (back * x[0] if t > 0 else 0)
    return out


def residual_tests(df: DataFrame, key: str, order: str, e: str, lags: int = 4) -> DataFrame:
    """Durbin-Watson, Jarque-Bera and Ljung-Box of residuals, one row a key, from sums."""
    w = W.by(key, order)
    mean = df.groupBy(key).agg(F.avg(e).alias("_m"))
    d = df.where(F.col(e).isNotNull()).join(mean, key).withColumn("_u", F.col(e) - F.col("_m"))
    d = d.withColumns({f"_u{h}": F.lag("_u", h).over(w) for h in range(1, lags + 1)} | {"_d": F.col(e) - F.lag(e).over(w)})
    n, ss = F.count("*"), F.sum(F.col("_u") ** 2)
    box = sum(((F.sum(F.col("_u") * F.col(f"_u{h}")) / ss) ** 2 / (n - h) for h in range(1, lags + 1)), F.lit(0.0))
    g = d.groupBy(key).agg(n.alias("n"), (F.sum(F.col("_d") ** 2) / F.sum(F.col(e) ** 2)).alias("durbin_watson"), (n / 6 * (F.skewness("_u") ** 2 + F.kurtosis("_u") ** 2 / 4)).alias("jarque_bera"), (n * (n + 2) * box).alias("ljung_box"))
    return g


def p_value(stat: float, dof: int) -> float:
    return O.chi2_sf(stat, dof)


def spectral_entropy(x: np.ndarray) -> float:
    """Entropy of the periodogram without its mean, 0 (one cycle) to 1 (noise)."""
    p = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2
    p = p / p.sum() if p.sum() > 0 else p
    p = p[p > 0]
    return float(-(p * np.log(p)).sum() / math.log(len(p))) if len(p) > 1 else 0.0


def structure(df: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """``entropy`` and the effective sample size from the lag-1 correlation, one row a key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[x].dropna().to_numpy(float)
        if len(v) < 8:
            return pd.DataFrame({key: [pdf[key].iloc[0]], "entropy": [np.nan], "n_effective": [float(len(v))]})
        rho = float(np.corrcoef(v[1:], v[:-1])[0, 1]) if v.std() > 0 else 0.0
        return pd.DataFrame({key: [pdf[key].iloc[0]], "entropy": [spectral_entropy(v)], "n_effective": [len(v) * (1 - rho) / (1 + rho)]})

    return df.groupBy(key).applyInPandas(run, f"{key} string, entropy double, n_effective double")


def quantile_bands(x: Column | str, w, n: int, least: int, qs: tuple[float, ...] = (0.05, 0.95)) -> dict[str, Column]:
    """Rolling empirical quantiles of the rows before the current one."""
    c = F.col(x) if isinstance(x, str) else x
    f = W.frame(w, n, 1)
    return {f"q{round(q * 100):02d}": W.enough(c, f, least, F.percentile(c, F.lit(q)).over(f)) for q in qs}


def seasonal_rank(df: DataFrame, key: str, month: Column, x: str) -> DataFrame:
    """Mean by calendar month and its place among the twelve."""
    g = df.groupBy(key, month.alias("m")).agg(F.avg(x).alias("mean"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("mean"), "m")))


def roll_offset(df: DataFrame, key: str, order: str, contract: str, near: str, far: str, most: int = 3, least_jump: float = 0.0025, support: float = 0.4) -> DataFrame:
    """Days by which each key's price jump trails its change of contract: the usual one, 0 without support.

    For each change, the day of 0..``most`` later whose near return differs most
    from its far return; the key's most frequent such day, if at least
    ``support`` of its changes agree.
    """
    w = W.by(key, order)
    gap = F.abs(F.col(near) / F.lag(near).over(w) - F.col(far) / F.lag(far).over(w))
    before = F.lag(contract).over(w)
    d = df.withColumn("_gap", gap).withColumn("_new", before.isNotNull() & ~before.eqNullSafe(F.col(contract)))
    ahead = [F.struct(F.coalesce(F.lead("_gap", k).over(w), F.lit(0.0)).alias("g"), F.lit(-k).alias("k")) for k in range(most + 1)]
    best = d.withColumn("_best", F.greatest(*ahead)).where("_new")
    votes = best.withColumn("_k", F.when(F.col("_best.g") >= least_jump, -F.col("_best.k"))).groupBy(key).agg(F.mode("_k", True).alias("usual"), F.count("*").alias("changes"), F.collect_list("_k").alias("_all"))
    agree = F.size(F.filter("_all", lambda v: v == F.col("usual"))) / F.col("changes")
    return votes.select(key, "changes", F.when(agree >= support, F.col("usual")).otherwise(0).alias("offset"), agree.alias("support"))


def orthogonal_residual(df: DataFrame, key: str, y: str, x: str, out: str = "residual") -> DataFrame:
    """What an earlier signal does not explain, by key."""
    fit = df.groupBy(key).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return df.join(fit, key).withColumn(out, F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")


def interval_share(df: DataFrame, key: str, group: str, inside: Column, k: float = 8.0) -> DataFrame:
    """Each key's share of values inside an interval, shrunk to its group's and the whole's."""
    i = df.groupBy(key, group).agg(F.sum(inside.cast("double")).alias("_s"), F.count(inside).alias("_n"))
    g = i.groupBy(group).agg(F.sum("_s").alias("_gs"), F.sum("_n").alias("_gn"))
    o = g.agg((F.sum("_gs") / F.sum("_gn")).alias("_p"))
    j = i.join(g, group).join(F.broadcast(o))
    share = scalars.shrink(F.try_divide("_s", "_n"), F.col("_n"), F.try_divide("_gs", "_gn"), F.col("_gn"), F.col("_p"), k)
    return j.select(key, share.alias("share"))


def dispersed(paths: DataFrame, key: str, step: str, value: str, factor: float, tilt: float = 0.0) -> DataFrame:
    """Paths spread about each key's and step's median by ``factor``, then shifted by ``tilt`` a step."""
    m = paths.groupBy(key, step).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    return paths.join(m, [key, step]).withColumn(value, F.col("_m") + (F.col(value) - F.col("_m")) * factor + tilt * F.col(step)).drop("_m")
