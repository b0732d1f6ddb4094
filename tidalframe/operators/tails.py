"""Quantile bands of a deviation's own distribution: empirical, kernel density, or Pareto tails; their bootstrap and coverage.

A window frame holds each row's trailing values, so a long series is not one
Python group: the windows of any rows are estimated together, many at a time.
Bootstrap draws fan out over tasks by (series, chunk of draws).

Tails: ``empirical`` (linear interpolation), ``kde`` (Gaussian, bandwidth by
Scott's rule, distribution function summed on 512 points), ``gpd`` (for levels
outside (0.1, 0.9): a generalised Pareto law of the exceedances of the window's
0.9 quantile, mirrored for low levels; empirical where a window has fewer than 20
values or fewer than ``LEAST`` exceedances).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W

LEVELS = (0.01, 0.05, 0.95, 0.99)
#: Exceedances that a Pareto fit needs, and the level of its threshold.
LEAST, THRESHOLD = 12, 0.9
TAILS = ("empirical", "kde", "gpd")
_GOLDEN = (5**0.5 - 1) / 2


def _sorted_quantile(s: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    """Linear quantile of each row of ``s``, sorted, of which the first ``n`` count."""
    at = np.maximum(n - 1, 0) * q
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, np.maximum(n - 1, 0))
    r = np.arange(len(s))
    a, b = s[r, low], s[r, high]
    return np.where(n > 0, a + (b - a) * (at - low), np.nan)


def pareto_fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape and scale of a generalised Pareto law for each row of positive exceedances (NaN: none), by maximum likelihood.

    For a given ratio t of shape to scale the best shape is the mean of log(1 + t x),
    so one unknown is left: a grid, then golden sections about its best point.
    Shapes above -1/2 only, where the estimate is regular.
    """
    count = np.isfinite(x).sum(1)
    mean, top = np.nanmean(x, 1), np.nanmax(x, 1)

    def profile(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood and shape at ``t`` (rows, points)."""
        inside = 1 + t[:, None, :] * x[:, :, None]
        shape = np.nansum(np.log(np.maximum(inside, 1e-300)), 1) / count[:, None]
        flat = np.abs(t) * mean[:, None] < 1e-9
        scale = np.where(flat, mean[:, None], shape / np.where(flat, 1.0, t))
        ok = (np.nanmin(inside, 1) > 0) & (shape > -0.5) & (scale > 0)
        return np.where(ok, -np.log(np.where(ok, scale, 1.0)) - shape - 1, -np.inf), np.where(flat, 0.0, shape)

    below = -(1 - np.geomspace(1e-6, 1, 25)[:-1]) / top[:, None]
    above = np.geomspace(1e-3, 100, 40) / mean[:, None]
    grid = np.concatenate([below, np.zeros((len(x), 1)), above], 1)
    best = profile(grid)[0].argmax(1)
    r = np.arange(len(x))
    low, high = grid[r, np.maximum(best - 1, 0)], grid[r, np.minimum(best + 1, grid.shape[1] - 1)]
    for _ in range(60):
        a, b = high - _GOLDEN * (high - low), low + _GOLDEN * (high - low)
        value, _ = profile(np.stack([a, b], 1))
        left = value[:, 0] >= value[:, 1]
        low, high = np.where(left, low, a), np.where(left, b, high)
    t = (low + high) / 2
    shape = profile(t[:, None])[1][:, 0]
    return shape, np.where(np.abs(t) * mean < 1e-9, mean, shape / np.where(t == 0, 1.0, t))


def _upper_tail(y: np.ndarray, n: np.ndarray, p: float, other: np.ndarray) -> np.ndarray:
    """The level ``p`` of each sorted row by the law of its exceedances; ``other`` where they are too few."""
    u = _sorted_quantile(y, n, THRESHOLD)
    over = np.where(y > u[:, None], y - u[:, None], np.nan)
    count = np.isfinite(over).sum(1)
    fits = np.flatnonzero((n >= 20) & (count >= LEAST))
    out = other.copy()
    if len(fits):
        shape, scale = pareto_fit(over[fits][:, np.isfinite(over[fits]).any(0)])
        left = n[fits] / count[fits] * (1 - p)
        flat = np.abs(shape) < 1e-6
        far = np.where(flat, -np.log(left), (left ** -np.where(flat, 1.0, shape) - 1) / np.where(flat, 1.0, shape))
        out[fits] = u[fits] + scale * far
    return out


def _density_quantiles(s: np.ndarray, n: np.ndarray, levels: tuple[float, ...], other: np.ndarray) -> np.ndarray:
    out = other.copy()
    for k in range(len(s)):
        x = s[k, : n[k]]
        width = x.std(ddof=1) * n[k] ** -0.2 if n[k] > 1 else 0.0
        if width > 0:
            grid = np.linspace(x[0], x[-1], 512)
            mass = np.cumsum(np.exp(-0.5 * ((grid[:, None] - x) / width) ** 2).sum(1))
            out[k] = np.interp(levels, mass / mass[-1], grid)
    return out


def window_quantiles(x: np.ndarray, levels: tuple[float, ...], tail: str) -> np.ndarray:
    """(rows, levels) of windows given as rows, NaN where a window is shorter; rows of fewer than three values give NaN."""
    if tail not in TAILS:
        raise ValueError(f"tail must be one of {TAILS}")
    s = np.sort(x, 1)  # NaN last
    n = np.isfinite(s).sum(1)
    out = np.stack([_sorted_quantile(s, n, q) for q in levels], 1)
    if tail == "kde":
        out = _density_quantiles(s, n, levels, out)
    elif tail == "gpd":
        mirrored = np.sort(-x, 1)
        for k, q in enumerate(levels):
            if q >= 0.9:
                out[:, k] = _upper_tail(s, n, q, out[:, k])
            elif q <= 0.1:
                out[:, k] = -_upper_tail(mirrored, n, 1 - q, -out[:, k])
    out[n < 3] = np.nan
    return out


def _stacked(rows: pd.Series) -> np.ndarray:
    size = max(map(len, rows), default=0)
    out = np.full((len(rows), max(size, 1)), np.nan)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _estimated(held: Column, levels: tuple[float, ...], tail: str) -> Column:
    @F.pandas_udf("array<double>")
    def estimate(rows: pd.Series) -> pd.Series:
        return pd.Series([row for at in range(0, len(rows), 512) for row in window_quantiles(_stacked(rows.iloc[at : at + 512]), levels, tail).tolist()])

    return estimate(held)


def band(q: float) -> str:
    return f"q{q:g}"


def rolling_bands(df: DataFrame, key: str, order: str, x: str, *, window: int = 104, tail: str = "gpd", levels: tuple[float, ...] = LEVELS, step: int = 1) -> DataFrame:
    """``key, order, x`` and a band for each level, from the ``window`` known values that end at the row.

    The first ``max(window // 2, 26)`` known rows of a series have none; with ``step`` a band is estimated at every ``step``-th row and carried on.
    """
    first, w = max(window // 2, 26), W.by(key, order)
    d = df.where(F.col(x).isNotNull() & ~F.isnan(x)).select(key, order, x, (F.row_number().over(w) - 1 - first).alias("_at"))
    held = F.collect_list(F.col(x).cast("double")).over(W.frame(w, window))
    here = (F.col("_at") >= 0) & (F.col("_at") % step == 0)
    d = d.withColumn("_held", F.when(here, held))
    # Only rows that are estimated go through Python.
    some = d.where("_held is not null").select("*", _estimated(F.col("_held"), levels, tail).alias("_q"))
    if step == 1:
        none = d.where("_held is null").select("*", F.lit(None).cast("array<double>").alias("_q"))
        both = some.unionByName(none)
        return both.select(key, order, x, *[F.col("_q")[k].alias(band(q)) for k, q in enumerate(levels)])
    both = some.unionByName(d.where("_held is null").select("*", F.lit(None).cast("array<double>").alias("_q")))
    carried = both.withColumn("_q", F.last("_q", ignorenulls=True).over(w))
    return carried.select(key, order, x, *[F.col("_q")[k].alias(band(q)) for k, q in enumerate(levels)])


def resampled_bands(df: DataFrame, key: str, order: str, x: str, *, window: int = 104, tail: str = "gpd", levels: tuple[float, ...] = LEVELS, draws: int = 1000, chunk: int = 100, seed: int = 0) -> DataFrame:
    """``key, n, level, point, low, high``: bands of each series' last ``window`` known values and the 2.5 and 97.5 percent points of their bootstrap.

    Series of fewer than 12 values have null bands. Draws depend on the seed, the series and their number, not on the partitioning.
    """
    w = Window.partitionBy(key).orderBy(F.desc(order))
    d = df.where(F.col(x).isNotNull() & ~F.isnan(x)).select(key, order, F.col(x).cast("double").alias("_x"), F.row_number().over(w).alias("_k")).where(F.col("_k") <= window)
    last = d.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("_k"), F.col("_x")))), lambda s: s["_x"]).alias("_x")).withColumn("n", F.size("_x"))
    enough = last.where("n >= 12")

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, values, part in zip(pdf["_key"], pdf["_x"], pdf["_part"], strict=True):
                v = np.asarray(values, float)
                if part < 0:
                    q = window_quantiles(v[None, :], levels, tail)
                else:
                    rng = np.random.default_rng((seed, zlib.crc32(str(name).encode()), int(part)))
                    q = window_quantiles(v[rng.integers(0, len(v), (min(chunk, draws - part * chunk), len(v)))], levels, tail)
                yield pd.DataFrame({"_key": str(name), "_point": part < 0, "level": np.tile(levels, len(q)), "value": q.ravel()})

    parts = enough.select(F.col(key).cast("string").alias("_key"), "_x", F.explode(F.sequence(F.lit(-1), F.lit(-(-draws // chunk) - 1))).alias("_part"))
    found = parts.repartition("_key", "_part").mapInPandas(drawn, "_key string, _point boolean, level double, value double")
    value = F.when(~F.isnan("value"), F.col("value"))
    ends = found.groupBy("_key", "level").agg(
        F.max(F.when(F.col("_point"), value)).alias("point"), F.percentile(F.when(~F.col("_point"), value), F.lit(0.025)).alias("low"), F.percentile(F.when(~F.col("_point"), value), F.lit(0.975)).alias("high")
    )
    each = last.select(key, F.col(key).cast("string").alias("_key"), "n", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    return each.join(ends, ["_key", "level"], "left").select(key, "n", "level", "point", "low", "high")


def coverage(df: DataFrame, key: str, x: str, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """``key, level, n, breach_rate, nominal, well_calibrated`` of bands named by ``band``: breaches above high levels, below low ones; well calibrated within a factor of two."""
    each = df.select(key, F.col(x).alias("_x"), F.explode(F.array(*[F.struct(F.lit(float(q)).alias("level"), F.col(f"`{band(q)}`").alias("b")) for q in levels])).alias("_s"))
    high, b = F.col("_s.level") >= 0.5, F.col("_s.b")
    each = each.where(F.col("_x").isNotNull() & b.isNotNull()).select(key, "_s.level", F.when(high, F.col("_x") > b).otherwise(F.col("_x") < b).alias("_hit"))
    g = each.groupBy(key, "level").agg(F.count("*").alias("n"), F.avg(F.col("_hit").cast("double")).alias("breach_rate"))
    nominal = F.when(F.col("level") >= 0.5, 1 - F.col("level")).otherwise(F.col("level"))
    rate = F.col("breach_rate")
    return g.select(key, "level", "n", "breach_rate", nominal.alias("nominal"), ((rate >= nominal / 2) & (rate <= nominal * 2)).alias("well_calibrated"))
