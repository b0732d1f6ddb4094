"""One latent factor behind a panel, what its surprises say, and how a break in them is answered."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from .folds import _null, grouped, known
from .simulate import arma_fit, arma_residuals


def factor_filter(z: np.ndarray, noise: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``state, nis, push`` of standardised columns ``z`` (rows x columns), one factor with unit shocks.

    Loadings are the first principal vector of the complete rows, the factor's
    own lag is the slope of its scores on the scores before, and each column
    has the idiosyncratic variance ``noise``. With loadings of unit length the
    innovation covariance inverts in closed form, so a row costs its columns,
    not their cube. Rows with a gap only predict.
    """
    n = len(z)
    state, nis, push = (np.full(n, np.nan) for _ in range(3))
    whole = np.isfinite(z).all(axis=1)
    if whole.sum() < 3:
        return state, nis, push
    load = np.linalg.eigh(np.cov(z[whole].T, bias=True).reshape(z.shape[1], -1))[1][:, -1]
    load = load * (1.0 if load[0] >= 0 else -1.0)
    score = z[whole] @ load
    back = float(score[:-1] @ score[:-1])
    lag = float(np.clip(score[1:] @ score[:-1] / back, -0.99, 0.99)) if back > 0 else 0.0
    mean, var = 0.0, 1 / (1 - lag * lag)
    for t in range(n):
        mean, var = lag * mean, lag * lag * var + 1
        if whole[t]:
            gap = z[t] - load * mean
            var = 1 / (1 / var + 1 / noise)
            push[t] = load @ gap
            nis[t] = gap @ gap / noise - var * (push[t] / noise) ** 2
            mean += var * push[t] / noise
        state[t] = mean
    return state, nis, push


def dynamic_factor(df: DataFrame, key: str, order: str, xs: list[str], noise: float = 0.5) -> DataFrame:
    """``factor, nis, deviation`` a row: the filtered factor and its signed surprise, both to unit deviation.

    The parameters see the whole series, the filter only the past. The factor
    is signed to go with the first column. A series with a constant column or
    fewer than three complete rows has nulls.
    """

    def unit(v: np.ndarray) -> np.ndarray:
        sd = np.nanstd(v) if np.isfinite(v).any() else 0.0
        return v / sd if sd > 0 else v

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.column_stack([known(pdf[x])[0] for x in xs])
        whole = np.isfinite(z).all(axis=1)
        if whole.sum() < 3 or (z[whole].std(axis=0) == 0).any():
            return pdf.assign(factor=np.nan, nis=np.nan, deviation=np.nan)
        z = (z - z[whole].mean(axis=0)) / z[whole].std(axis=0)
        state, nis, push = factor_filter(z, noise)
        sign = -1.0 if np.corrcoef(state[whole], z[whole, 0])[0, 1] < 0 else 1.0
        surprise = np.where(sign * push < 0, -1.0, 1.0) * np.sqrt(np.maximum(nis, 0))
        return pdf.assign(factor=unit(sign * (state - state.mean())), nis=nis, deviation=unit(surprise))

    outputs = {"factor": "double", "nis": "double", "deviation": "double"}
    return _null(grouped(df.select(key, order, *xs), key, order, outputs, f), *outputs)


def break_response(df: DataFrame, key: str, order: str, x: str, breach: Column, chance: Column | None = None, burn: int = 8, window: int = 52, least: int = 10) -> DataFrame:
    """``broke_at, restated``: values since the first break, on the location and scale of the new regime.

    The break is the earliest row with ``breach``, or with ``chance`` over one
    half after the first ``burn`` rows. The regime's median and population
    deviation are those of its last ``window`` rows; a regime of fewer than
    ``least`` rows changes nothing.
    """
    w, whole = W.by(key, order), Window.partitionBy(key)
    df = df.withColumn("_n", F.row_number().over(w)).withColumn("_breach", F.coalesce(breach, F.lit(False)))
    if chance is not None:
        df = df.withColumn("_breach", F.col("_breach") | (F.coalesce(chance > 0.5, F.lit(False)) & (F.col("_n") > burn)))
    df = df.withColumn("broke_at", F.min(F.when(F.col("_breach"), F.col(order))).over(whole))
    post = F.coalesce(F.col(order) >= F.col("broke_at"), F.lit(False)) & F.col(x).isNotNull()
    df = df.withColumn("_post", post)
    df = df.withColumn("_back", F.row_number().over(Window.partitionBy(key, "_post").orderBy(F.desc(order))))
    regime = F.when(F.col("_post") & (F.col("_back") <= window), F.col(x))
    many = F.count(F.when(F.col("_post"), F.lit(1))).over(whole) >= least
    df = df.withColumn("_center", F.percentile(regime, F.lit(0.5)).over(whole)).withColumn("_spread", F.stddev_pop(regime).over(whole)).withColumn("_many", many)
    spread = F.when(F.col("_spread") > 0, F.col("_spread")).otherwise(1.0)
    restated = F.when(F.col("_post") & F.col("_many"), (F.col(x) - F.col("_center")) / spread).otherwise(F.col(x))
    return df.withColumn("restated", restated).drop("_n", "_breach", "_post", "_back", "_center", "_spread", "_many")


def burn_in_z(df: DataFrame, key: str, order: str, x: str, out: str = "z") -> DataFrame:
    """Distance from the median of the first rows in 1.4826 median distances of those.

    The first rows are a quarter of the known ones, 26 at least and 52 at most.
    Without spread the population deviation serves, and one where that is zero.
    """
    whole = Window.partitionBy(key)
    seen = F.count(x).over(W.by(key, order).rowsBetween(Window.unboundedPreceding, 0))
    first = seen <= F.least(F.greatest(F.floor(F.count(x).over(whole) / 4), F.lit(26)), F.lit(52))
    df = df.withColumn("_early", F.when(first, F.col(x))).withColumn("_center", F.percentile("_early", F.lit(0.5)).over(whole))
    mad = 1.4826 * F.percentile(F.abs(F.col("_early") - F.col("_center")), F.lit(0.5)).over(whole)
    sd = F.stddev_pop("_early").over(whole)
    df = df.withColumn("_spread", F.when(mad > 0, mad).when(sd > 0, sd).otherwise(1.0))
    return df.withColumn(out, (F.col(x) - F.col("_center")) / F.col("_spread")).drop("_early", "_center", "_spread")


def surprise_blend(df: DataFrame, key: str, order: str, resid: str, others: list[str], window: int = 52, rank: int = 52) -> DataFrame:
    """``nis, blend``: mean trailing mid-rank of the surprise and the other intensities, signed by the residual.

    The surprise is the squared residual over its rolling population variance.
    The mean is over the ranks that are known; a null or zero residual gives 0.
    """
    w = W.by(key, order)
    frame, least = W.frame(w, window), W.half(window)
    var = W.enough(F.col(resid), frame, least, F.var_pop(resid).over(frame))
    df = df.withColumn("nis", F.when(var > 0, F.col(resid) ** 2 / var))
    names = [f"_rank{k}" for k in range(len(others) + 1)]
    for name, c in zip(names, ["nis", *others], strict=True):
        df = df.withColumn(name, W.mid_rank(c, w, rank, W.half(rank)))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in names[1:]), F.coalesce(names[0], F.lit(0.0)))
    known_ = sum((F.col(c).isNotNull().cast("int") for c in names[1:]), F.col(names[0]).isNotNull().cast("int"))
    return df.withColumn("blend", F.when(known_ > 0, total / known_ * F.signum(F.coalesce(resid, F.lit(0.0))))).drop(*names)


# --- exogenous forecasts -------------------------------------------------------------


def exogenous_walk_forward(df: DataFrame, key: str, order: str, y: str, z: str, share: float = 0.35, refit: int = 8) -> DataFrame:
    """``forecast, plain, before`` over the last ``share`` of each series: one-step ARIMA(1,1,1) with and without ``z``.

    Changes of y are regressed on changes of z and the remainder is an
    ARMA(1, 1); slope and ARMA are fitted in turn, twice, every ``refit`` rows
    on the rows before. The coming z is known, as it is published first. Rows
    with a gap are left out; a series needs 40 rows.
    """

    def fit(dy: np.ndarray, dz: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray]:
        slope, ar, ma = 0.0, np.zeros(1), np.zeros(1)
        for _ in range(1 if dz is None else 2):
            if dz is not None and np.any(dz != 0):  # both sides filtered by the ARMA; its unknown first shock fades as (-ma)^t
                fades = (-ma[0]) ** np.arange(len(dy))
                x = np.column_stack([arma_residuals(dz, ar, ma), fades])
                slope = float(np.linalg.lstsq(x, arma_residuals(dy, ar, ma), rcond=None)[0][0])
            ar, ma, _ = arma_fit(dy if dz is None else dy - slope * dz, 1, 1)
            ar, ma = np.clip(ar, -1, 1), np.clip(ma, -1, 1)
        return slope, ar, ma

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[y, z]).sort_values(order).reset_index(drop=True)
        n, out = len(pdf), {"forecast": [], "plain": [], "before": []}
        split = int(n * (1 - share)) if n >= 40 else n
        dy, dz = np.diff(pdf[y].to_numpy(float)), np.diff(pdf[z].to_numpy(float))
        for t in range(split, n):
            past, before = dy[: t - 1], float(pdf[y].iloc[t - 1])
            if (t - split) % refit == 0:
                models = {"forecast": fit(past, dz[: t - 1]), "plain": fit(past, None)}
            for name, (slope, ar, ma) in models.items():
                rest = past - slope * dz[: t - 1]
                step = ar[0] * rest[-1] + ma[0] * arma_residuals(rest, ar, ma)[-1]
                out[name].append(before + slope * dz[t - 1] + step)
            out["before"].append(before)
        return pdf.iloc[split:].assign(**out)

    narrow = df.select(key, order, y, z)
    fields = ", ".join(f"`{c}` {t}" for c, t in narrow.dtypes)
    return narrow.groupBy(key).applyInPandas(run, f"{fields}, forecast double, plain double, before double")


# --- scorecard -------------------------------------------------------------------------


def gate(added: Column, surrogate_p: Column, held_out: Column, t: Column, deflated: Column) -> Column:
    """The pass rule; an unknown deflated ratio is no bar, any other unknown is. 0.05 and 3."""
    rules = [added > 0, surrogate_p < 0.05, held_out > 0, F.abs(t) > 3]
    passed = F.coalesce(deflated > 0, F.lit(True))
    for rule in rules:
        passed = passed & F.coalesce(rule, F.lit(False))
    return passed


def scorecard(df: DataFrame, key: str, order: str, z: str, y: str, yearly: float = 52.0, horizon: int = 8) -> DataFrame:
    """One row a series: crossings a year of 0, 1 and 2, turns a year, half-life, and how ``z`` ranks the change of y ``horizon`` rows ahead.

    ``t`` counts rows that overlap once (n over horizon); ``hit`` is 0.5 + ic / 2.
    """
    w = W.by(key, order)
    a, v, b = F.lag(z).over(w), F.col(z), F.lead(z).over(w)
    ahead = F.lead(y, horizon).over(w) - F.col(y)
    marks = df.select(key, order, v.alias("_z"), a.alias("_a"), ahead.alias("_ahead"), F.when((v - a) * (b - v) < 0, 1).otherwise(0).alias("_turn"), *[W.crossings(z, w, float(k)).alias(f"_c{k}") for k in (0, 1, 2)])
    both = F.when(F.col("_ahead").isNotNull() & F.col("_z").isNotNull(), F.lit(1))
    for c in ("_z", "_ahead"):
        x = F.when(both == 1, F.col(c))
        among = Window.partitionBy(key, both)
        marks = marks.withColumn(f"_r{c}", F.when(both == 1, F.rank().over(among.orderBy(x)) + (F.count("*").over(Window.partitionBy(key, both, x)) - 1) / 2))
    slope = F.regr_slope(F.col("_z") - F.col("_a"), F.col("_a"))
    per_year = {f"cross{k}_per_yr": F.sum(f"_c{k}") * yearly / F.count("_z") for k in (0, 1, 2)} | {"turns_per_yr": F.sum("_turn") * yearly / F.count("_z")}
    out = marks.groupBy(key).agg(F.count("_z").alias("n"), *[c.alias(k) for k, c in per_year.items()], F.when(slope < 0, -math.log(2) / slope).alias("half_life"), F.corr("_r_z", "_r_ahead").alias("ic"), F.count(both).alias("_m"))
    spare = F.col("_m") / horizon - 2
    t = F.when((spare > 0) & (F.abs("ic") < 1), F.col("ic") * F.sqrt(spare / (1 - F.col("ic") ** 2)))
    return out.withColumn("t", t).withColumn("hit", 0.5 + F.col("ic") / 2).drop("_m")
