"""Linear models whose data part is one pass of sums.

A design of k columns becomes its k x k Gram matrix by a partial aggregate;
only that matrix reaches the driver, where numpy solves it. Least squares with
a constant takes covariances in place of sums of products, which lose digits
where means are large beside deviations. Iterative fits
(robust, quantile, generalised linear) repeat the pass with new weights, which
are expressions of the current coefficients.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from . import optimize as O


def gram(df: DataFrame, cols: list[Column], weight: Column | None = None) -> tuple[int, np.ndarray]:
    """Rows, and sums of products of all pairs of ``cols``; rows with a null are left out."""
    names = [f"_g{k}" for k in range(len(cols))]
    d = df.select(*[c.cast("double").alias(n) for c, n in zip(cols, names, strict=True)], (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w")).dropna()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = d.agg(F.count("*").alias("n"), *[F.sum(F.col(names[i]) * F.col(names[j]) * F.col("_w")).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
    return row["n"], out


def centred(df: DataFrame, cols: list[Column]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means, and sums of products of deviations from the means; rows with a null are left out. One pass, merged without raw sums."""
    names = [f"_g{k}" for k in range(len(cols))]
    d = df.select(*[c.cast("double").alias(n) for c, n in zip(cols, names, strict=True)]).dropna()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = d.agg(F.count("*").alias("n"), *[F.avg(n).alias(f"m{k}") for k, n in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row["n"] * (row[f"s{i}_{j}"] or 0.0)
    return row["n"], np.array([row[f"m{k}"] or 0.0 for k in range(len(cols))]), out


def scaled_inverse(a: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of a symmetric matrix, its columns brought to one scale first."""
    size = np.sqrt(np.abs(np.diag(a)))
    size = np.where(size > 0, size, 1.0)
    return np.linalg.pinv(a / np.outer(size, size), hermitian=True) / np.outer(size, size)


def design(xs: list[str], intercept: bool = True) -> list[Column]:
    return ([F.lit(1.0)] if intercept else []) + [F.col(x) for x in xs]


def predict(coef, xs: list[str], intercept: bool = True) -> Column:
    out = F.lit(0.0)
    for b, c in zip(coef, design(xs, intercept), strict=True):
        out = out + F.lit(float(b)) * c
    return out


def ols(df: DataFrame, y: str, xs: list[str], *, intercept: bool = True, ridge: float = 0.0) -> dict:
    """Coefficients, standard errors, t, p, R2, residual variance and the Gram inverse."""
    if not intercept:
        return ols_of(*gram(df, [*design(xs, False), F.col(y)]), intercept=False, ridge=ridge)
    return ols_centred(*centred(df, [F.col(c) for c in (*xs, y)]), ridge=ridge)


def ols_centred(n: int, mean: np.ndarray, s: np.ndarray, *, ridge: float = 0.0) -> dict:
    """The same, with a constant (not penalised), from means and sums of products of deviations of the regressors and, last, the response."""
    a, b, yy, m = s[:-1, :-1], s[:-1, -1], float(s[-1, -1]), mean[:-1]
    part = scaled_inverse(a + ridge * np.eye(len(b)))
    slope = part @ b
    ssr = max(0.0, float(yy - 2 * slope @ b + slope @ a @ slope))
    # From coefficients about the means to those of the plain design.
    turn = np.eye(len(b) + 1)
    turn[0, 1:] = -m
    middle = np.zeros_like(turn)
    middle[0, 0], middle[1:, 1:] = 1 / max(n, 1), part
    return _fit(n, np.concatenate([[mean[-1] - m @ slope], slope]), turn @ middle @ turn.T, ssr, yy) | {"middle": middle, "turn": turn, "mean": mean}


def ols_of(n: int, g: np.ndarray, *, intercept: bool = True, ridge: float = 0.0) -> dict:
    """The same from a Gram matrix of the design (the constant first, if any) and, last, the response."""
    a, b, yy = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    penalty = ridge * np.eye(len(b))
    if intercept:
        penalty[0, 0] = 0
    inverse = np.linalg.pinv(a + penalty)
    coef = inverse @ b
    ssr = max(0.0, float(yy - 2 * coef @ b + coef @ a @ coef))
    return _fit(n, coef, inverse, ssr, yy - g[0, -1] ** 2 / n if intercept and n else yy)


def _fit(n: int, coef: np.ndarray, inverse: np.ndarray, ssr: float, total: float) -> dict:
    dof = max(1, n - len(coef))
    se = np.sqrt(np.maximum(np.diag(inverse) * ssr / dof, 0))
    t = np.divide(coef, se, out=np.zeros_like(coef), where=se > 0)
    return {"n": n, "coef": coef, "se": se, "t": t, "p": np.array([O.t_sf(float(v), dof) for v in t]), "r2": 1 - ssr / total if total else math.nan, "ssr": ssr, "dof": dof, "inverse": inverse}


def newey_west(df: DataFrame, key: str, order: str, y: str, xs: list[str], lags: int) -> dict:
    """OLS with standard errors robust to autocorrelation up to ``lags`` (Bartlett weights)."""
    fit = ols(df, y, xs)
    k, w = len(xs) + 1, W.by(key, order)
    d = df.select(key, order, y, *xs).dropna()
    about = [F.lit(1.0), *[F.col(x) - float(m) for x, m in zip(xs, fit["mean"], strict=False)]]
    score = [c * (F.col(y) - predict(fit["coef"], xs)) for c in about]
    d = d.select(key, order, *[s.alias(f"u{i}") for i, s in enumerate(score)])
    d = d.select(*[f"u{i}" for i in range(k)], *[F.lag(f"u{i}", h).over(w).alias(f"u{i}_{h}") for h in range(1, lags + 1) for i in range(k)])
    row = d.agg(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}" if h == 0 else f"u{j}_{h}")).alias(f"s{h}_{i}_{j}") for h in range(lags + 1) for i in range(k) for j in range(k)]).first()
    meat = np.zeros((k, k))
    for h in range(lags + 1):
        s = np.array([[row[f"s{h}_{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
        meat += s if h == 0 else (1 - h / (lags + 1)) * (s + s.T)
    to = fit["turn"] @ fit["middle"]
    cov = to @ meat @ to.T
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    t = fit["coef"] / np.where(se > 0, se, np.nan)
    return fit | {"se": se, "t": t, "p": np.array([2 * (1 - O.normal_cdf(abs(v))) for v in t])}


def reweighted(df: DataFrame, y: str, xs: list[str], weight: Callable[[Column], Column], rounds: int = 25, tol: float = 1e-8, ridge: float = 1e-10) -> np.ndarray:
    """Coefficients of repeated least squares whose weights are a function of the residual."""
    coef = ols(df, y, xs)["coef"]
    for _ in range(rounds):
        w = weight(F.col(y) - predict(coef, xs))
        _, g = gram(df, [*design(xs), F.col(y)], w)
        new = np.linalg.solve(g[:-1, :-1] + ridge * np.eye(len(coef)), g[:-1, -1])
        moved, coef = float(np.abs(new - coef).max() / (1 + np.abs(coef).max())), new
        if moved < tol:
            break
    return coef


def quantile_regression(df: DataFrame, y: str, xs: list[str], q: float, rounds: int = 40, smooth: float = 1e-6) -> np.ndarray:
    """Linear quantile regression by smoothed reweighting."""
    return reweighted(df, y, xs, lambda e: F.when(e >= 0, q).otherwise(1 - q) / F.greatest(F.abs(e), F.lit(smooth)), rounds)


def huber(df: DataFrame, y: str, xs: list[str], k: float = 1.345) -> np.ndarray:
    """Huber's M-estimate; the scale is 1.4826 times the residuals' median size, fixed after the first fit."""
    coef = ols(df, y, xs)["coef"]
    scale = 1.4826 * (df.select(F.abs(F.col(y) - predict(coef, xs)).alias("e")).agg(F.percentile_approx("e", 0.5, 100000)).first()[0] or 1.0)
    return reweighted(df, y, xs, lambda e: F.least(F.lit(1.0), k * scale / F.greatest(F.abs(e), F.lit(1e-12))))


def influence(df: DataFrame, y: str, x: str) -> DataFrame:
    """``leverage, cooks`` of each row of a simple regression."""
    fit = ols(df, y, [x])
    m = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).agg(F.avg(x).alias("m"), F.var_pop(x).alias("v")).first()
    n, s2 = fit["n"], fit["ssr"] / fit["dof"]
    h = 1 / n + (F.col(x) - m["m"]) ** 2 / (n * m["v"])
    e = F.col(y) - predict(fit["coef"], [x])
    return df.withColumn("leverage", h).withColumn("cooks", e * e / (2 * s2) * F.col("leverage") / (1 - F.col("leverage")) ** 2)


def vif(df: DataFrame, xs: list[str]) -> dict[str, float]:
    """Variance inflation of each regressor, auxiliary regressions without intercept."""
    _, g = gram(df, design(xs, False))
    return dict(zip(xs, vif_of(g), strict=True))


def vif_of(g: np.ndarray) -> list[float]:
    return (np.diag(g) * np.diag(np.linalg.pinv(g))).tolist()


def drop_collinear(df: DataFrame, xs: list[str], most: float = 10.0) -> list[str]:
    """Regressors left after dropping the most inflated until all are below ``most``: one pass over the data."""
    _, g = gram(df, design(xs, False))
    return [xs[k] for k in independent(g, most)]


def independent(g: np.ndarray, most: float = 10.0) -> list[int]:
    """Places of the columns that are left, from the Gram matrix."""
    left = list(range(len(g)))
    while len(left) > 1:
        part = g[np.ix_(left, left)]
        v = np.diag(part) * np.diag(np.linalg.pinv(part))
        if v.max() < most:
            break
        left.pop(int(np.argmax(v)))
    return left


# --- generalised linear models ---------------------------------------------------------


def glm(df: DataFrame, y: str, xs: list[str], *, link: str = "logit", weight: str | None = None, penalty: dict[str, float] | float = 0.0, rounds: int = 25, tol: float = 1e-8) -> np.ndarray:
    """Binary regression by Fisher scoring, ridge chosen for each coefficient (never the intercept).

    ``link``: logit or cloglog. A round is one distributed pass.
    """
    pen = np.array([0.0] + [penalty.get(x, 0.0) if isinstance(penalty, dict) else penalty for x in xs])
    base = df.where(F.col(y).isNotNull()).agg(F.avg(F.col(y).cast("double"))).first()[0] or 0.5
    base = min(max(base, 1e-6), 1 - 1e-6)
    coef = np.zeros(len(xs) + 1)
    coef[0] = math.log(base / (1 - base)) if link == "logit" else math.log(-math.log1p(-base))
    case = F.lit(1.0) if weight is None else F.col(weight)
    for _ in range(rounds):
        eta = predict(coef, xs)
        if link == "logit":
            mu = 1 / (1 + F.exp(-eta))
            slope = mu * (1 - mu)
        else:
            safe = F.least(F.greatest(eta, F.lit(-30.0)), F.lit(5.0))
            mu, slope = 1 - F.exp(-F.exp(safe)), F.exp(safe - F.exp(safe))
        var = F.greatest(mu * (1 - mu), F.lit(1e-12))
        z = eta + (F.col(y).cast("double") - mu) / F.greatest(slope, F.lit(1e-12))
        _, g = gram(df, [*design(xs), z], case * slope * slope / var)
        new = np.linalg.solve(g[:-1, :-1] + np.diag(pen) + 1e-12 * np.eye(len(coef)), g[:-1, -1])
        moved, coef = float(np.abs(new - coef).max()), new
        if moved < tol:
            break
    return coef


def elastic_net(df: DataFrame, y: str, xs: list[str], l1: float, l2: float = 0.0, rounds: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Coordinate descent on the Gram matrix of standardised columns; coefficients on the original scale."""
    return elastic_net_of(*gram(df, [*design(xs), F.col(y)]), l1, l2, rounds, tol)


def elastic_net_of(n: int, g: np.ndarray, l1: float, l2: float = 0.0, rounds: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """The same from the Gram matrix of a constant, the regressors and the response."""
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 1e-300))
    c, r = cov[:-1, :-1] / np.outer(sd, sd), cov[:-1, -1] / sd
    b = np.zeros(len(r))
    for _ in range(rounds):
        old = b.copy()
        for k in range(len(r)):
            rho = r[k] - c[k] @ b + c[k, k] * b[k]
            b[k] = math.copysign(max(abs(rho) - l1, 0.0), rho) / (c[k, k] + l2)
        if np.abs(b - old).max() < tol:
            break
    slope = b / sd
    return np.concatenate([[mean[-1] - slope @ mean[:-1]], slope])


# --- principal components ------------------------------------------------------------------


def pca(df: DataFrame, xs: list[str], k: int, anchor: str | None = None) -> dict:
    """Fit on ``df``: columns scaled by their population deviation, eigenvalues of the sample covariance.

    If the first component correlates negatively with ``anchor`` (the first
    column if none), all components are negated.
    """
    return pca_of(*gram(df, design(xs)), k, xs.index(anchor) if anchor else 0) | {"columns": xs}


def pca_of(n: int, g: np.ndarray, k: int, at: int = 0) -> dict:
    """The same from the Gram matrix of a constant and the columns; ``at``: place of the anchor."""
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    sd = np.where(sd > 0, sd, 1.0)
    corr = cov / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(corr * n / max(1, n - 1))
    order = np.argsort(-values)[:k]
    loads = vectors[:, order]
    if (corr @ loads)[at, 0] < 0:
        loads = -loads
    return {"mean": mean, "sd": sd, "loadings": loads, "values": values[order], "share": values[order] / values.sum()}


def project(df: DataFrame, model: dict, prefix: str = "pc") -> DataFrame:
    cols = {}
    for j in range(model["loadings"].shape[1]):
        e = F.lit(0.0)
        for x, m, s, b in zip(model["columns"], model["mean"], model["sd"], model["loadings"][:, j], strict=True):
            e = e + (F.col(x) - float(m)) / float(s) * float(b)
        cols[f"{prefix}{j + 1}"] = e
    return df.withColumns(cols)


# --- three-factor curves -----------------------------------------------------------------------


def curve_factors(df: DataFrame, date: str, tenor: str, value: str, decay: float, least: int = 3) -> DataFrame:
    """``b0, b1, b2, rmse`` a date: 3 x 3 normal equations by Cramer's rule, no Python.

    Dates with fewer than ``least`` tenors have null factors.
    """
    from ..functions.scalars import curve_loadings

    load = curve_loadings(tenor, decay)
    d = df.where(F.col(value).isNotNull()).select(date, F.col(value).alias("_y"), load["slope"].alias("_s"), load["curvature"].alias("_c"))
    terms = {"n": F.lit(1.0), "s": F.col("_s"), "c": F.col("_c"), "ss": F.col("_s") ** 2, "sc": F.col("_s") * F.col("_c"), "cc": F.col("_c") ** 2, "y": F.col("_y"), "sy": F.col("_s") * F.col("_y"), "cy": F.col("_c") * F.col("_y"), "yy": F.col("_y") ** 2}
    m = d.groupBy(date).agg(*[F.sum(e).alias(f"_m{k}") for k, e in terms.items()])
    v = {k: F.col(f"_m{k}") for k in terms}

    def det(a, b, c):
        return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])

    rows = [[v["n"], v["s"], v["c"]], [v["s"], v["ss"], v["sc"]], [v["c"], v["sc"], v["cc"]]]
    right = [v["y"], v["sy"], v["cy"]]
    whole = det(*rows)
    ok = (v["n"] >= least) & (F.abs(whole) > 1e-12)
    for j in range(3):
        swapped = [[right[i] if k == j else rows[i][k] for k in range(3)] for i in range(3)]
        m = m.withColumn(f"b{j}", F.when(ok, det(*swapped) / whole))
    fit = F.col("b0") * v["y"] + F.col("b1") * v["sy"] + F.col("b2") * v["cy"]
    return m.withColumn("rmse", F.sqrt(F.greatest(v["yy"] - fit, F.lit(0.0)) / v["n"])).select(date, "b0", "b1", "b2", "rmse")


def best_decay(df: DataFrame, date: str, tenor: str, value: str, grid: list[float]) -> tuple[float, float]:
    """The decay of least mean error over a grid: one job, the grid exploded in place."""
    parts = [curve_factors(df, date, tenor, value, g).agg(F.avg("rmse").alias("rmse")).withColumn("decay", F.lit(g)) for g in grid]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    row = out.agg(F.min(F.struct("rmse", "decay")).alias("best")).first()["best"]
    return row["decay"], row["rmse"]


# --- vector autoregression ------------------------------------------------------------------------


def var_fit(df: DataFrame, key: str, order: str, cols: list[str], lags: int) -> dict:
    """Least squares of each column on ``lags`` lags of all, and information criteria."""
    w = W.by(key, order)
    lagged = [F.lag(c, h).over(w).alias(f"{c}__{h}") for h in range(1, lags + 1) for c in cols]
    d = df.select(*cols, *lagged)
    xs = [f"{c}__{h}" for h in range(1, lags + 1) for c in cols]
    n, mean, s = centred(d, [F.col(c) for c in (*xs, *cols)])
    p, k = 1 + len(xs), len(cols)
    a, b, yy = s[: p - 1, : p - 1], s[: p - 1, p - 1 :], s[p - 1 :, p - 1 :]
    fits = [ols_centred(n, np.append(mean[: p - 1], mean[p - 1 + j]), np.block([[a, b[:, [j]]], [b[:, j], yy[j, j]]])) for j in range(k)]
    coef, inverse = np.column_stack([f["coef"] for f in fits]), fits[0]["inverse"]
    slope = coef[1:]
    resid = yy - slope.T @ b - b.T @ slope + slope.T @ a @ slope
    ml = resid / n
    logdet, free = float(np.linalg.slogdet(ml)[1]), p * k
    return {
        "n": n, "lags": lags, "columns": cols, "coef": coef, "inverse": inverse, "sigma": resid / max(1, n - p), "aic": logdet + 2 * free / n, "bic": logdet + math.log(n) * free / n,
        "hqic": logdet + 2 * math.log(math.log(n)) * free / n, "fpe": ((n + p) / (n - p)) ** k * math.exp(logdet), "matrices": [coef[1 + h * k : 1 + (h + 1) * k].T for h in range(lags)],
    }


def impulse_responses(fit: dict, horizon: int, orthogonal: bool = True) -> np.ndarray:
    """(horizon + 1, response, shock)."""
    k = len(fit["columns"])
    out = [np.eye(k)]
    for h in range(1, horizon + 1):
        out.append(sum(fit["matrices"][j] @ out[h - 1 - j] for j in range(min(h, fit["lags"]))))
    return np.stack(out) @ (np.linalg.cholesky(fit["sigma"]) if orthogonal else np.eye(k))


def variance_shares(fit: dict, horizon: int) -> np.ndarray:
    """(response, shock) shares of the forecast error variance."""
    part = (impulse_responses(fit, horizon - 1) ** 2).sum(axis=0)
    return part / part.sum(axis=1, keepdims=True)


def granger(df: DataFrame, key: str, order: str, y: str, x: str, lags: int) -> dict:
    """F test that lags of x do not help lags of y."""
    w = W.by(key, order)
    own, other = [f"{y}__{h}" for h in range(1, lags + 1)], [f"{x}__{h}" for h in range(1, lags + 1)]
    d = df.select(y, *[F.lag(c, h).over(w).alias(f"{c}__{h}") for c in (y, x) for h in range(1, lags + 1)]).dropna()
    full, short = ols(d, y, own + other), ols(d, y, own)
    f = (short["ssr"] - full["ssr"]) / lags / (full["ssr"] / full["dof"])
    return {"n": full["n"], "f": f, "p": O.f_sf(f, lags, full["dof"])}


#: Asymptotic 1, 5 and 10 percent points of the unit-root t with a constant.
UNIT_ROOT = {0.01: -3.43, 0.05: -2.86, 0.10: -2.57}


def unit_root(df: DataFrame, key: str, order: str, x: str, lags: int = 1) -> dict:
    """Augmented Dickey-Fuller t with a constant, and whether a unit root is rejected at 5 percent."""
    w = W.by(key, order)
    d = df.select(key, order, F.col(x).alias("_x"), (F.col(x) - F.lag(x).over(w)).alias("_d"), F.lag(x).over(w).alias("_b"))
    d = d.select("_d", "_b", *[F.lag("_d", h).over(w).alias(f"_d{h}") for h in range(1, lags + 1)]).dropna()
    fit = ols(d, "_d", ["_b", *[f"_d{h}" for h in range(1, lags + 1)]])
    return {"n": fit["n"], "t": float(fit["t"][1]), "stationary": bool(fit["t"][1] < UNIT_ROOT[0.05])}
