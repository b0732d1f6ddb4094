"""Ordered, stateful folds over one series at a time.

Where the state is the last one set, a window finds it; other recursions run
in ``applyInPandas``, one group a series, in one pass over its rows. A
series' rows meet in one task because a causal recursion is sequential; the
parallelism is over series.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hysteresis(df: DataFrame, key: str, order: str, z: str, entry: float = 2.0, leave: float = 0.5, out: str = "signal") -> DataFrame:
    """-1 above ``entry``, +1 below ``-entry``, 0 within ``leave``; flips at once; null keeps the state.

    Every value beyond or within sets the state whatever it was, so the state is the last one set.
    """
    v, w = F.col(z), Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sets = F.when(v >= entry, -1).when(v <= -entry, 1).when(F.abs(v) <= leave, 0)
    return df.select(key, order, z, F.coalesce(F.last(sets, ignorenulls=True).over(w), F.lit(0)).alias(out))


def contrarian(df: DataFrame, key: str, order: str, z: str, entry: float = 1.5, leave: float = 0.5, out: str = "stance") -> DataFrame:
    """Strict entry from flat, one-sided exit, no flip; null keeps the state."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        state, states = 0, []
        for v in known(pdf[z])[0]:
            if state and v * -state < leave:
                state = 0
            elif not state and abs(v) > entry:
                state = -1 if v > 0 else 1
            states.append(state)
        return pdf.assign(**{out: states})

    return grouped(df.select(key, order, z), key, order, {out: "int"}, f)


def grouped(df: DataFrame, key: str, order: str, outputs: dict[str, str], f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``f`` over each key's rows in order; ``outputs`` are its further columns and their types."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in outputs.items()]])
    names = [f.name for f in schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return f(pdf)[names]

    return df.groupBy(key).applyInPandas(run, schema)


def known(x: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    v = pd.to_numeric(x, errors="coerce").to_numpy(float)
    at = np.isfinite(v)
    return v, at


# --- exponentially weighted --------------------------------------------------


def ew_moments(v: np.ndarray, halflife: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjusted exponentially weighted mean, unbiased variance and count of known values so far.

    Weights fall with every row, known or not; sums are carried in one pass.
    """
    decay, w, w2, wx, wxx, n = 0.5 ** (1 / halflife), 0.0, 0.0, 0.0, 0.0, 0
    mean, var, count = np.full(len(v), np.nan), np.full(len(v), np.nan), np.zeros(len(v), int)
    shift = v[np.isfinite(v)][0] if np.isfinite(v).any() else 0.0
    for k, x in enumerate(v):
        w, w2, wx, wxx = w * decay, w2 * decay * decay, wx * decay, wxx * decay
        if math.isfinite(x):
            x -= shift
            w, w2, wx, wxx, n = w + 1, w2 + 1, wx + x, wxx + x * x, n + 1
        count[k] = n
        if n:
            m = wx / w
            mean[k] = m + shift
            bias = w * w - w2
            if bias > 1e-300 and n > 1:
                var[k] = max(0.0, (wxx / w - m * m)) * w * w / bias
    return mean, var, count


def ewma_z(df: DataFrame, key: str, order: str, x: str, halflife: float, out: str = "z") -> DataFrame:
    """Distance from the exponentially weighted mean in such standard deviations; ``halflife`` values needed."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        v, _ = known(pdf[x])
        mean, var, n = ew_moments(v, halflife)
        with np.errstate(all="ignore"):
            z = np.where((var > 0) & (n >= int(halflife)), (v - mean) / np.sqrt(var), np.nan)
        return pdf.assign(**{out: z})

    return _null(grouped(df, key, order, {out: "double"}, f), out)


def ewma_vol_scale(df: DataFrame, key: str, order: str, x: str, halflife: float, out: str = "scaled") -> DataFrame:
    """The value over the exponentially weighted standard deviation of its changes."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        v, _ = known(pdf[x])
        change = np.concatenate([[np.nan], np.diff(v)])
        _, var, n = ew_moments(change, halflife)
        with np.errstate(all="ignore"):
            return pdf.assign(**{out: np.where((var > 0) & (n >= int(halflife)), v / np.sqrt(var), np.nan)})

    return _null(grouped(df, key, order, {out: "double"}, f), out)


def _null(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


# --- state-space filters --------------------------------------------------------


def kalman_regression(y: np.ndarray, x: np.ndarray, delta: float = 1e-4, least: int = 30) -> dict[str, np.ndarray]:
    """Random-walk intercept and slope; ``resid`` is the one-step innovation.

    With two states the filter is five plain numbers a row. The observation
    variance is the static regression's (two degrees of freedom fewer; 1e-6 for
    an exact fit), the state starts diffuse.
    """
    out = {k: np.full(len(y), np.nan) for k in ("alpha", "beta", "resid")}
    at = np.flatnonzero(np.isfinite(y) & np.isfinite(x))
    if len(at) < least:
        return out
    u, v = x[at] - x[at].mean(), y[at] - y[at].mean()
    left = v - u * (u @ v / (u @ u) if u.any() else 0.0)
    noise = float(left @ left) / (len(at) - 2) or 1e-6
    drift = noise * delta / (1 - delta)
    alpha = beta = both = 0.0
    var_a = var_b = 1000.0
    for k, xk, yk in zip(at.tolist(), x[at].tolist(), y[at].tolist(), strict=True):
        var_a, var_b = var_a + drift, var_b + drift
        # How the states move with the forecast, and how far that is spread.
        with_a, with_b = var_a + both * xk, both + var_b * xk
        spread = with_a + with_b * xk + noise
        miss = yk - alpha - beta * xk
        alpha, beta = alpha + with_a * miss / spread, beta + with_b * miss / spread
        var_a, both, var_b = var_a - with_a * with_a / spread, both - with_a * with_b / spread, var_b - with_b * with_b / spread
        out["alpha"][k], out["beta"][k], out["resid"][k] = alpha, beta, miss
    return out


def tvp_regression(df: DataFrame, key: str, order: str, y: str, x: str, delta: float = 1e-4) -> DataFrame:
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(**kalman_regression(known(pdf[y])[0], known(pdf[x])[0], delta))

    return _null(grouped(df, key, order, {"alpha": "double", "beta": "double", "resid": "double"}, f), "alpha", "beta", "resid")


def trend_filter(y: np.ndarray, obs: float, level: float, slope: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Filtered level and slope of a local linear trend, and the log likelihood (first two values left out)."""
    n = len(y)
    lv, sl, like, seen = np.full(n, np.nan), np.full(n, np.nan), 0.0, 0
    state, p = np.zeros(2), np.diag([1e7, 1e7])
    t, q = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([level, slope])
    for k in range(n):
        if seen:
            state, p = t @ state, t @ p @ t.T + q
        if math.isfinite(y[k]):
            f = p[0, 0] + obs
            v = y[k] - state[0]
            gain = p[:, 0] / f
            state, p = state + gain * v, p - np.outer(gain, p[0])
            seen += 1
            if seen > 2:
                like -= 0.5 * (math.log(2 * math.pi * f) + v * v / f)
        lv[k], sl[k] = state
    return lv, sl, like


#: Variances of observation, level and slope as multiples of the series' own.
PRESETS = {"responsive": (0.30, 0.02, 0.05), "smooth": (0.30, 0.02, 5e-4)}


def preset_variances(df: DataFrame, key: str, x: str) -> DataFrame:
    """``key, preset, obs, level, slope`` of each preset, from the population variance of each series' known values (1 where it is 0 or unknown)."""
    v = df.groupBy(key).agg(F.var_pop(F.when(~F.isnan(x), F.col(x))).alias("_v"))
    v = v.withColumn("_v", F.when(F.col("_v") > 0, F.col("_v")).otherwise(1.0))
    rows = [F.struct(F.lit(n).alias("preset"), *[(F.col("_v") * m).alias(c) for c, m in zip(("obs", "level", "slope"), p, strict=True)]) for n, p in PRESETS.items()]
    return v.select(key, F.inline(F.array(*rows)))


def trend_variances(v: np.ndarray) -> tuple[float, float, float]:
    """Variances of observation, level and slope by maximum likelihood; gaps are NaN."""
    from .optimize import nelder_mead

    seen = v[np.isfinite(v)]
    base = max(float(np.nanvar(np.diff(seen))) if len(seen) > 2 else 1.0, 1e-12)
    best = nelder_mead(lambda p: -trend_filter(v, *np.exp(np.clip(p, -40, 40)))[2], np.log([base / 2, base / 2, base / 100]), steps=150)
    return tuple(np.exp(np.clip(best, -40, 40)).tolist())


def local_linear_trend(df: DataFrame, key: str, order: str, x: str, fixed: tuple[float, float, float] | None = None) -> DataFrame:
    """``level, trend``: with ``fixed`` variances (observation, level, slope), else by maximum likelihood."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        v, _ = known(pdf[x])
        level, slope, _ = trend_filter(v, *(trend_variances(v) if fixed is None else fixed))
        return pdf.assign(level=level, trend=slope)

    return _null(grouped(df, key, order, {"level": "double", "trend": "double"}, f), "level", "trend")


# --- recursive filters ------------------------------------------------------------


#: The published filters round the root of 2 and its half so.
ROOT_2, HALF_ROOT_2 = 1.414, 0.707


def supersmoother(x: np.ndarray, period: float) -> np.ndarray:
    """Two-pole low pass of the given period."""
    a = math.exp(-ROOT_2 * math.pi / period)
    c2, c3 = 2 * a * math.cos(ROOT_2 * math.pi / period), -a * a
    c1, out = 1 - c2 - c3, np.array(x, float)
    for k in range(2, len(x)):
        out[k] = c1 * (x[k] + x[k - 1]) / 2 + c2 * out[k - 1] + c3 * out[k - 2]
    return out


def highpass(x: np.ndarray, period: float) -> np.ndarray:
    """Two-pole high pass of the given period."""
    w = HALF_ROOT_2 * 2 * math.pi / period
    a = (math.cos(w) + math.sin(w) - 1) / math.cos(w)
    out = np.zeros(len(x))
    for k in range(2, len(x)):
        out[k] = (1 - a / 2) ** 2 * (x[k] - 2 * x[k - 1] + x[k - 2]) + 2 * (1 - a) * out[k - 1] - (1 - a) ** 2 * out[k - 2]
    return out


def roofing(x: np.ndarray, low: float, high: float) -> np.ndarray:
    return supersmoother(highpass(x, high), low)


def hilbert_phase(osc: np.ndarray, period: float = 20) -> dict[str, np.ndarray]:
    """Causal phase: the quadrature is the fall since the last row, to the scale of a cosine of this period (0 on the first row)."""
    quad = np.zeros(len(osc))
    quad[1:] = (osc[:-1] - osc[1:]) / (2 * math.sin(math.pi / period))
    phase = np.arctan2(quad, osc)
    return {"amplitude": np.hypot(osc, quad), "phase": phase, "sine": np.sin(phase), "lead": np.sin(phase + math.pi / 4)}


def cycle_filters(df: DataFrame, key: str, order: str, x: str, low: float = 10, high: float = 48, period: float = 20) -> DataFrame:
    """``smooth, band, amplitude, phase, sine, lead``; nulls are left out of the recursions."""
    cols = ["smooth", "band", "amplitude", "phase", "sine", "lead"]

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        v, at = known(pdf[x])
        out = {c: np.full(len(v), np.nan) for c in cols}
        if at.sum() < 3:
            return pdf.assign(**out)
        band = roofing(v[at], low, high)
        out["smooth"][at], out["band"][at] = supersmoother(v[at], low), band
        for name, values in hilbert_phase(band, period).items():
            out[name][at] = values
        return pdf.assign(**out)

    return _null(grouped(df, key, order, {c: "double" for c in cols}, f), *cols)


# --- change points and control charts ------------------------------------------------


def bocpd(x: np.ndarray, hazard: float = 1 / 100, recent: int = 4) -> np.ndarray:
    """Chance that the current run began within the last ``recent`` rows.

    Values of a run are normal with a normal-inverse-gamma prior (0, 1, 1, 1),
    so their predictive is Student's t. All run lengths are kept: exact, and
    quadratic in the length of the series. Where no run can explain a value
    (all likelihoods vanish), a new run begins for sure. Unknown values are passed over.
    """
    out, n = np.full(len(x), np.nan), 0
    weight = np.ones(1)  # by run length, shortest first
    total, square = np.zeros(1), np.zeros(1)  # of each run's values
    gamma = np.asarray([math.lgamma(1.5 + k / 2) - math.lgamma(1 + k / 2) for k in range(len(x) + 1)])
    for k in np.flatnonzero(np.isfinite(x)):
        v, m = x[k], np.arange(n + 1)
        mean = total / (m + 1)
        beta = 1 + (square - total * mean) / 2
        dof, spread = 2.0 + m, beta * (m + 2) / ((1 + m / 2) * (m + 1))
        like = np.exp(gamma[: n + 1] - 0.5 * np.log(dof * math.pi * spread) - (dof + 1) / 2 * np.log1p((v - mean) ** 2 / (dof * spread)))
        each = weight * like
        evidence = each.sum()
        weight = np.concatenate([[hazard], each / evidence * (1 - hazard)]) if evidence > 0 and math.isfinite(evidence) else np.eye(1, n + 2)[0]
        total, square, n = np.concatenate([[0.0], total + v]), np.concatenate([[0.0], square + v * v]), n + 1
        out[k] = weight[: recent + 1].sum()
    return out


def change_points(df: DataFrame, key: str, order: str, x: str, hazard: float = 1 / 100, recent: int = 4) -> DataFrame:
    return _null(grouped(df, key, order, {"p_change": "double"}, lambda p: p.assign(p_change=bocpd(known(p[x])[0], hazard, recent))), "p_change")


#: Boundary constants of the cumulative-sum test at 1, 5 and 10 percent.
CUSUM_BOUND = {0.01: 1.143, 0.05: 0.948, 0.10: 0.850}


def cusum(df: DataFrame, key: str, order: str, x: str, level: float = 0.05) -> DataFrame:
    """``path, bound, breach``: cumulative deviations over their standard deviation. Not causal: uses the whole mean."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        v, at = known(pdf[x])
        path, bound = np.full(len(v), np.nan), np.full(len(v), np.nan)
        n = int(at.sum())
        if n > 2 and np.std(v[at], ddof=1) > 0:
            path[at] = np.cumsum(v[at] - v[at].mean()) / (np.std(v[at], ddof=1) * math.sqrt(n))
            bound[at] = CUSUM_BOUND[level] * (1 + 2 * np.arange(1, n + 1) / n)
        return pdf.assign(path=path, bound=bound, breach=np.abs(path) > bound)

    return _null(grouped(df, key, order, {"path": "double", "bound": "double", "breach": "boolean"}, f), "path", "bound")


class Barometer:
    """Conjugate normal posterior of a barometer from its count and sum, with a Page chart against the posterior mean.

    Fixed values of the defaults: prior mean 57, prior variance 180, noise variance 120, allowance 3, limit 15.
    """

    def __init__(self, mean: float = 57.0, var: float = 180.0, noise: float = 120.0, slack: float = 3.0, limit: float = 15.0):
        self.prior, self.prior_var, self.noise, self.slack, self.limit = mean, var, noise, slack, limit
        self.n, self.total, self.up, self.down = 0, 0.0, 0.0, 0.0

    @property
    def var(self) -> float:
        return 1 / (1 / self.prior_var + self.n / self.noise)

    @property
    def mean(self) -> float:
        return (self.prior / self.prior_var + self.total / self.noise) / (1 / self.prior_var + self.n / self.noise)

    def update(self, x: float) -> int:
        """The alert: +1, -1 or 0. The observation moves the mean first, then the chart; only the side that alerts is reset."""
        self.n, self.total = self.n + 1, self.total + x
        gap = x - self.mean
        self.up, self.down = max(0.0, self.up + gap - self.slack), max(0.0, self.down - gap - self.slack)
        if self.up > self.limit:
            self.up = 0.0
            return 1
        if self.down > self.limit:
            self.down = 0.0
            return -1
        return 0

    def interval(self) -> tuple[float, float]:
        half = 1.96 * math.sqrt(self.var)
        return max(0.0, self.mean - half), min(100.0, self.mean + half)


def barometer_history(df: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """``mean, sd, low, high, alert`` after each observation, in order; unknown values change nothing."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        b, rows = Barometer(), []
        for v in known(pdf[x])[0]:
            alert = b.update(v) if math.isfinite(v) else 0
            rows.append((b.mean, math.sqrt(b.var), *b.interval(), alert))
        return pdf.assign(**{c: [r[k] for r in rows] for k, c in enumerate(("mean", "sd", "low", "high", "alert"))})

    return grouped(df, key, order, {"mean": "double", "sd": "double", "low": "double", "high": "double", "alert": "int"}, f)


# --- futures rolls -----------------------------------------------------------------------


def spliced_returns(df: DataFrame, key: str, order: str, near: str, far: str, contract: str, most: float = 0.5) -> DataFrame:
    """``roll, ret, level``: returns without the jump at a change of contract.

    On a roll the near price is compared with yesterday's far price, which was
    the same contract. Prices of zero or less and returns above ``most`` in
    size are dropped (the level stands still).
    """
    from ..functions import windows as W

    w = W.by(key, order)
    before = F.lag(contract).over(w)
    roll = (before.isNotNull() & ~before.eqNullSafe(F.col(contract))).cast("int")
    base = F.when(roll == 1, F.lag(far).over(w)).otherwise(F.lag(near).over(w))
    raw = F.when((F.col(near) > 0) & (base > 0), F.col(near) / base - 1)
    out = df.withColumn("roll", roll).withColumn("ret", F.when(F.abs(raw) <= most, raw))
    return out.withColumn("level", 100 * W.level("ret", w))
