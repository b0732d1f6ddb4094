"""Trailing, causal window functions over keyed series.

Every function takes a value column and a window ``W`` made by ``by(keys,
order)``; frames count rows and end at the current row, so no result looks
ahead. Null values are skipped; a result needs ``min_periods`` values. NaN is
not null in Spark: sources turn it into null first (``nan_to_null``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by(keys: str | list[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*order)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x: Column | str) -> Column:
    return F.when(~F.isnan(_c(x)), _c(x))


def frame(w: WindowSpec, n: int, skip: int = 0) -> WindowSpec:
    """The last ``n`` rows that end ``skip`` rows before the current one."""
    return w.rowsBetween(-(n - 1) - skip, -skip)


def enough(x: Column, f: WindowSpec, min_periods: int, then: Column) -> Column:
    return F.when(F.count(x).over(f) >= min_periods, then)


def half(n: int, least: int = 10) -> int:
    return max(n // 2, least)


def rolling_z(x: Column | str, w: WindowSpec, n: int, min_periods: int | None = None, center: float | None = None) -> Column:
    """Distance from the rolling mean (or ``center``) in population standard deviations."""
    x, f, least = _c(x), frame(w, n), half(n) if min_periods is None else min_periods
    sd = F.stddev_pop(x).over(f)
    middle = F.avg(x).over(f) if center is None else F.lit(center)
    return enough(x, f, least, F.when(sd > 0, (x - middle) / sd))


def bollinger(x: Column | str, w: WindowSpec, n: int, k: float = 2.0) -> dict[str, Column]:
    x, f = _c(x), frame(w, n)
    mid, sd = F.avg(x).over(f), F.stddev_pop(x).over(f)
    return {c: enough(x, f, n, e) for c, e in (("mid", mid), ("upper", mid + k * sd), ("lower", mid - k * sd))}


def below_share(x: Column | str, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    """Share of the window's rows strictly below the last value; null rows stay in the denominator."""
    x, f, least = _c(x), frame(w, n), half(n) if min_periods is None else min_periods
    held = F.collect_list(x).over(f)
    below = F.size(F.filter(held, lambda v: v < F.element_at(held, -1)))
    return enough(x, f, least, F.when(x.isNotNull(), below / F.count(F.lit(1)).over(f)))


def argsort_rank(x: Column | str, w: WindowSpec, n: int, min_periods: int) -> Column:
    """Place of the last value in the sorted window over its size, in (0, 1]; equal values come before it."""
    x, f = _c(x), frame(w, n)
    held = F.collect_list(x).over(f)
    at = F.size(F.filter(held, lambda v: v <= F.element_at(held, -1)))
    return enough(x, f, min_periods, F.when(x.isNotNull(), at / F.size(held)))


def signed_rank(x: Column | str, w: WindowSpec, n: int, min_periods: int) -> Column:
    """``2 rank - 1``: in (-1, 1]."""
    return 2 * argsort_rank(x, w, n, min_periods) - 1


def mid_rank(x: Column | str, w: WindowSpec, n: int, min_periods: int) -> Column:
    """Share below plus half the share equal, nulls left out."""
    x, f = _c(x), frame(w, n)
    held = F.collect_list(x).over(f)
    last = F.element_at(held, -1)
    score = F.aggregate(held, F.lit(0.0), lambda s, v: s + F.when(v < last, 1.0).when(v == last, 0.5).otherwise(0.0))
    return enough(x, f, min_periods, F.when(x.isNotNull(), score / F.size(held)))


def forward_fill(x: Column | str, w: WindowSpec, limit: int | None = None) -> Column:
    """The last value that isn't null, at most ``limit`` rows back."""
    return F.last(_c(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))


def cot_index(x: Column | str, w: WindowSpec, n: int) -> Column:
    """Place between the window's least and greatest value, 0 to 100."""
    x, f = _c(x), frame(w, n)
    lo, hi = F.min(x).over(f), F.max(x).over(f)
    return enough(x, f, n // 2, F.when(hi > lo, 100.0 * (x - lo) / (hi - lo)))


def fisher(x: Column | str, w: WindowSpec, n: int, clip: float = 0.999) -> Column:
    """Inverse hyperbolic tangent of the place between the extremes, scaled to [-1, 1]."""
    x, f = _c(x), frame(w, n)
    lo, hi = F.min(x).over(f), F.max(x).over(f)
    v = F.greatest(F.lit(-clip), F.least(F.lit(clip), 2 * (x - lo) / (hi - lo) - 1))
    return enough(x, f, n // 2, F.when(hi > lo, 0.5 * F.log((1 + v) / (1 - v))))


def median(x: Column | str, w: WindowSpec, n: int, min_periods: int, skip: int = 0) -> Column:
    x, f = _c(x), frame(w, n, skip)
    return enough(x, f, min_periods, F.percentile(x, F.lit(0.5)).over(f))


def robust_z(df: DataFrame, x: str, out: str, w: WindowSpec, n: int, min_periods: int | None = None) -> DataFrame:
    """Distance from the rolling median over 1.4826 rolling medians of such distances."""
    least = half(n) if min_periods is None else min_periods
    m, d = f"_{out}_median", f"_{out}_away"
    df = df.withColumn(m, median(x, w, n, least)).withColumn(d, F.abs(F.col(x) - F.col(m)))
    scale = 1.4826 * median(d, w, n, least)
    return df.withColumn(out, F.when(scale > 0, (F.col(x) - F.col(m)) / scale)).drop(m, d)


def change(x: Column | str, w: WindowSpec, k: int = 1) -> Column:
    return _c(x) - F.lag(_c(x), k).over(w)


def pct_change(x: Column | str, w: WindowSpec, k: int = 1) -> Column:
    before = F.lag(_c(x), k).over(w)
    return F.when(before != 0, _c(x) / before - 1)


def volatility(x: Column | str, w: WindowSpec, n: int, min_periods: int | None = None, yearly: float = 1.0) -> Column:
    """Sample standard deviation of a change column, scaled by the root of ``yearly``."""
    x, f = _c(x), frame(w, n)
    return enough(x, f, n if min_periods is None else min_periods, F.stddev_samp(x).over(f) * F.sqrt(F.lit(yearly)))


def rolling_beta(y: Column | str, x: Column | str, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    """Slope of y on x over rows where both are known."""
    y, x, f = _c(y), _c(x), frame(w, n)
    both = F.when(y.isNotNull() & x.isNotNull(), F.lit(1))
    return F.when(F.count(both).over(f) >= (n if min_periods is None else min_periods), F.regr_slope(y, x).over(f))


def running_sum(x: Column | str, w: WindowSpec) -> Column:
    return F.sum(_c(x)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def running_max(x: Column | str, w: WindowSpec) -> Column:
    return F.max(_c(x)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def level(returns: Column | str, w: WindowSpec) -> Column:
    """Cumulative product of one plus return; a null return keeps the level."""
    return F.product(1 + F.coalesce(_c(returns), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def ffd_weights(d: float, n: int) -> list[float]:
    """Weights of fractional differencing, newest first."""
    out = [1.0]
    for k in range(1, n):
        out.append(-out[-1] * (d - k + 1) / k)
    return out


def fractional_difference(x: Column | str, w: WindowSpec, d: float, n: int) -> Column:
    """Fixed-width fractional difference; needs a full window of known values."""
    x, f = _c(x), frame(w, n)
    weights = F.array(*[F.lit(v) for v in reversed(ffd_weights(d, n))])
    held = F.collect_list(x).over(f)
    total = F.aggregate(F.zip_with(held, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(held) == n, total)


def ar1_forecast(df: DataFrame, x: str, out: str, w: WindowSpec, n: int = 36, least: int = 24) -> DataFrame:
    """Forecast of each row from an AR(1) over the ``n`` rows before it.

    The slope is the pairs' sample covariance over the population variance of
    the earlier values, with a small constant against zero.
    """
    b = f"_{out}_before"
    df = df.withColumn(b, F.lag(x).over(w))
    pairs, rows = w.rowsBetween(-(n - 1), -1), w.rowsBetween(-n, -1)
    y, z = F.col(x), F.col(b)
    ok = y.isNotNull() & z.isNotNull()
    y_, z_ = F.when(ok, y), F.when(ok, z)
    slope = F.covar_samp(z_, y_).over(pairs) / (F.var_pop(z_).over(pairs) + 1e-10)
    intercept = F.avg(y_).over(pairs) - slope * F.avg(z_).over(pairs)
    return df.withColumn(out, F.when(F.count(y).over(rows) >= least, intercept + slope * z)).drop(b)


def crossings(x: Column | str, w: WindowSpec, at: float = 0.0) -> Column:
    """1 where the series crosses ``at`` between this row and the one before."""
    a, b = F.lag(_c(x)).over(w) - at, _c(x) - at
    return F.when(a * b < 0, 1).otherwise(0)
