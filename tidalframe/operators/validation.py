"""Out-of-sample studies as windows and one-pass sums: no refit reads a row twice.

An expanding regression is a ratio of running sums, a rolling-origin fan a
trailing deviation against a later row; lag-weighted regressions search their
weights on one matrix of sums of products.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from . import linear
from .optimize import nelder_mead


def expanding_forecasts(df: DataFrame, key: str, order: str, y: str, x: str, least: int = 120) -> DataFrame:
    """``forecast``: of ``y`` from ``x`` by least squares over all earlier complete rows, ``least`` of them at least."""
    w = W.by(key, order).rowsBetween(Window.unboundedPreceding, -1)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n, sx, sy, sxx, sxy = (F.sum(c).over(w) for c in (F.lit(1.0), F.col(x), F.col(y), F.col(x) * F.col(x), F.col(x) * F.col(y)))
    slope = F.try_divide(sxy - sx * sy / n, sxx - sx * sx / n)
    return d.withColumn("forecast", F.when(n >= least, sy / n + slope * (F.col(x) - sx / n)))


def forecast_scores(df: DataFrame, key: str, y: str, forecast: str, before: str) -> DataFrame:
    """A key's errors against those of no change, and how often the direction of change is right."""
    d = df.where(F.col(forecast).isNotNull() & F.col(y).isNotNull() & F.col(before).isNotNull())
    e, naive = F.col(y) - F.col(forecast), F.col(y) - F.col(before)
    rmse, flat = F.sqrt(F.avg(e * e)), F.sqrt(F.avg(naive * naive))
    right = (F.signum(F.col(forecast) - F.col(before)) == F.signum(naive)).cast("double")
    return d.groupBy(key).agg(F.count("*").alias("n"), rmse.alias("rmse"), F.avg(F.abs(e)).alias("mae"), flat.alias("naive_rmse"), F.try_divide(rmse, flat).alias("ratio"), F.avg(right).alias("direction"))


#: Standard normal quantiles at 95 and 75 percent.
Z95, Z75 = 1.6448536269514722, 0.6744897501960817


def rolling_origin(df: DataFrame, key: str, order: str, price: str, horizon: int = 6, look: int = 60, every: int = 4) -> DataFrame:
    """Lognormal fans from every ``every``-th row, against the price ``horizon`` rows later.

    A fan's deviation is that of the last ``look`` log returns. One row a key:
    origins, share of outcomes inside the 90 and 50 percent bands, and root
    mean squared errors without drift and with the trailing mean as drift.
    """
    w = W.by(key, order)
    back = w.rowsBetween(1 - look, 0)
    d = df.withColumn("_r", F.log(F.col(price) / F.lag(price).over(w)))
    d = d.withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count("_r").over(back)).withColumn("_sd", F.stddev_samp("_r").over(back)).withColumn("_m", F.avg("_r").over(back)).withColumn("_later", F.lead(price, horizon).over(w))
    d = d.where((F.col("_n") == look) & (F.col("_k") % every == 0) & F.col("_later").isNotNull())
    moved, wide = F.abs(F.log(F.col("_later") / F.col(price))), F.col("_sd") * F.sqrt(F.lit(float(horizon)))
    inside = lambda z: F.avg((moved <= z * wide).cast("double"))
    rmse = lambda guess: F.sqrt(F.avg((F.col("_later") - guess) ** 2))
    return d.groupBy(key).agg(F.count("*").alias("origins"), inside(Z95).alias("cover90"), inside(Z75).alias("cover50"), rmse(F.col(price)).alias("rmse_flat"), rmse(F.col(price) * F.exp(horizon * F.col("_m"))).alias("rmse_trend"))


def roll_diagnostics(df: DataFrame, key: str, order: str, price: str, far: str, contract: str, next_contract: str, most: float = 8.0) -> DataFrame:
    """A key's rolls: how many and how many a year, price jumps off rolls that look like missed ones, rolls whose
    new contract was not yesterday's next one, and mean absolute returns on roll days (spliced) and others."""
    w = W.by(key, order)
    before, last = F.lag(contract).over(w), F.lag(price).over(w)
    d = df.withColumn("_roll", before.isNotNull() & ~before.eqNullSafe(F.col(contract))).withColumn("_skip", ~F.lag(next_contract).over(w).eqNullSafe(F.col(contract)))
    raw = F.abs(F.when((F.col(price) > 0) & (last > 0), F.col(price) / last - 1))
    d = d.withColumn("_raw", raw)
    size = F.count("_raw").over(w.rowsBetween(-62, 0))
    d = d.withColumn("_usual", F.when(size >= 20, F.percentile("_raw", F.lit(0.5)).over(w.rowsBetween(-62, 0))))
    base = F.when(F.col("_roll"), F.lag(far).over(w)).otherwise(last)
    d = d.withColumn("_ret", F.abs(F.when((F.col(price) > 0) & (base > 0), F.col(price) / base - 1)))
    n, years = F.sum(F.col("_roll").cast("long")), F.greatest(F.max(F.year(order)) - F.min(F.year(order)), F.lit(1))
    return d.groupBy(key).agg(
        n.alias("rolls"), (n / years).alias("a_year"), F.sum((~F.col("_roll") & (F.col("_raw") > most * F.col("_usual"))).cast("long")).alias("jumps_off_rolls"),
        F.sum((F.col("_roll") & F.col("_skip")).cast("long")).alias("skips"), F.avg(F.when(F.col("_roll"), F.col("_ret"))).alias("on_rolls"), F.avg(F.when(~F.col("_roll"), F.col("_ret"))).alias("off_rolls"),
    )


def compare_versions(versions: DataFrame, key: str, date: str, version: str, value: str, base: str, crowded: float) -> DataFrame:
    """Each version against ``base`` on common dates: rows, correlation, first crowded date and its lead in days."""
    b = versions.where(F.col(version) == base).select(key, date, F.col(value).alias("_base"))
    first = lambda c: F.min(F.when(F.col(c) > crowded, F.col(date)))
    return versions.join(b, [key, date]).where(F.col(value).isNotNull() & F.col("_base").isNotNull()).groupBy(key, version).agg(
        F.count("*").alias("n"), F.corr(value, "_base").alias("corr"), first(value).alias("first_crowded"), F.date_diff(first("_base"), first(value)).alias("lead_days")
    )


def lag_weighted_regression(df: DataFrame, y: str, lags: str, k: int, bounds: tuple[float, float] = (1.0, 30.0), starts: int = 5, seed: int = 42) -> dict:
    """``y`` on the beta-weighted sum of ``k`` lags: weights and coefficients of least squared error.

    One pass gathers the sums of products of the lags, ``y`` and 1, a matrix
    of k + 2 columns whatever the number of rows. For given weights the
    coefficients and their squared error follow from it, so the search over
    the two shape parameters (from several starts) reads no data.
    """
    n, g = linear.gram(df, [F.lit(1.0), *[F.col(lags)[i] for i in range(k)], F.col(y)])
    u = (np.arange(k) + 1) / (k + 1)

    def weights(shape) -> np.ndarray:
        a, b = np.clip(shape, *bounds)
        w = np.exp((a - 1) * np.log(u) + (b - 1) * np.log1p(-u))
        return w / w.sum()

    def solved(shape) -> tuple[float, np.ndarray]:
        turn = np.zeros((k + 2, 3))
        turn[0, 0], turn[1:-1, 1], turn[-1, 2] = 1, weights(shape), 1
        m = turn.T @ g @ turn
        coef = np.linalg.pinv(m[:2, :2]) @ m[:2, 2]
        return float(m[2, 2] - coef @ m[:2, 2]), coef

    rng = np.random.default_rng(seed)
    first = [np.array([1.5, 5.0]), *rng.uniform(*bounds, (starts - 1, 2))]
    best = min((nelder_mead(lambda s: solved(s)[0], s) for s in first), key=lambda s: solved(s)[0])
    rss, coef = solved(best)
    shape = np.clip(best, *bounds)
    return {"n": n, "shape": shape, "weights": weights(shape), "coef": coef, "rss": rss, "r2": 1 - rss / (g[-1, -1] - g[0, -1] ** 2 / n)}
