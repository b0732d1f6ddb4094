"""Models of whole vector columns.

``summed`` is their one data step: each task turns its Arrow batches into
matrices (no copy), adds up what a function of them gives, and hands on one row;
a second round adds the tasks' rows in ``SPREAD`` places. The driver gets
``SPREAD`` rows of fixed size, whatever the number of vectors, and solves. The
plan has two columns, not one for each product of two dimensions.

Rows whose vector is null, of another length, or holds null or NaN are left out,
as are rows with a null or NaN among the other columns.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear

#: Tasks of the second round of a sum.
SPREAD = 16


def width(df: DataFrame, x: str) -> int:
    """Length of the vectors: that of the first one found."""
    row = df.where(F.col(x).isNotNull()).select(F.size(x)).first()
    return row[0] if row else 0


def complete(df: DataFrame, x: str, others: list[Column], dim: int) -> DataFrame:
    """``x`` and ``o0, o1...``, of the rows that count."""
    d = df.select(F.col(x).cast("array<double>").alias("x"), *[c.cast("double").alias(f"o{k}") for k, c in enumerate(others)])
    good = (F.size("x") == dim) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    for k in range(len(others)):
        good = good & F.col(f"o{k}").isNotNull() & ~F.isnan(f"o{k}")
    return d.where(good)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def summed(df: DataFrame, f: Callable[..., np.ndarray], dim: int, size: int) -> np.ndarray:
    """Sum over all rows of ``complete`` of ``f(x, o0, ...)``: matrices of a batch to ``size`` numbers."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += f(matrix(b.column(0), dim), *[b.column(k).to_numpy(zero_copy_only=False) for k in range(1, b.num_columns)])
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % SPREAD], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["place", "total"])

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(size), False
        for b in batches:
            if b.num_rows:
                total, any_ = total + matrix(b.column(1), size).sum(0), True
        if any_:
            yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], ["total"])

    parts = df.mapInArrow(part, "place int, total array<double>").repartition(SPREAD, "place").mapInArrow(added, "total array<double>")
    rows = parts.toArrow().column(0).to_pylist()
    return np.sum(np.array(rows, float).reshape(-1, size), 0)


def moments(df: DataFrame, x: str, others: list[Column] = (), dim: int | None = None) -> tuple[int, np.ndarray]:
    """Rows, and the Gram matrix of a constant, the vector's elements and ``others``."""
    dim = width(df, x) if dim is None else dim
    k = 1 + dim + len(others)

    def products(v: np.ndarray, *rest: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(v)), v, *rest])
        return (z.T @ z).ravel()

    g = summed(complete(df, x, list(others), dim), products, dim, k * k).reshape(k, k)
    return round(g[0, 0]), g


def gram_entries(df: DataFrame, x: str) -> DataFrame:
    """``i, j, total``: the upper half of the vectors' Gram matrix, as a table."""
    dim = width(df, x)
    _, g = moments(df, x, dim=dim)
    rows = [(i, j, float(g[i + 1, j + 1])) for i in range(dim) for j in range(i, dim)]
    return df.sparkSession.createDataFrame(rows, "i int, j int, total double")


def pca(df: DataFrame, x: str, k: int, at: int = 0) -> dict:
    """Components of the scaled vectors; as ``linear.pca``, the anchor is element ``at``."""
    return linear.pca_of(*moments(df, x), k, at)


def product(x: str, shift: np.ndarray, m: np.ndarray) -> Column:
    """``(x - shift) m`` as an array; null where the vector is null or of another length."""

    @F.pandas_udf("array<double>")
    def times(rows: pd.Series) -> pd.Series:
        good = [k for k, r in enumerate(rows) if r is not None and len(r) == len(shift)]
        out: list = [None] * len(rows)
        if good:
            for k, row in zip(good, (np.array([rows.iloc[k] for k in good], float) - shift) @ m, strict=True):
                out[k] = row.tolist()
        return pd.Series(out, dtype=object)

    return times(F.col(x).cast("array<double>"))


def project(df: DataFrame, x: str, model: dict, prefix: str = "pc") -> DataFrame:
    k = model["loadings"].shape[1]
    d = df.withColumn("_scores", product(x, model["mean"], model["loadings"] / model["sd"][:, None]))
    return d.withColumns({f"{prefix}{j + 1}": F.col("_scores")[j] for j in range(k)}).drop("_scores")


def linear_models(df: DataFrame, x: str, y: Column, *, ridge: float = 1.0, l1: float = 0.01, mixed: tuple[float, float] = (0.005, 0.5)) -> dict[str, np.ndarray]:
    """Coefficients (the constant first) of least squares, ridge, lasso and elastic net: one pass for all four."""
    n, g = moments(df, x, [y])
    return {"ols": linear.ols_of(n, g)["coef"], "ridge": linear.ols_of(n, g, ridge=ridge)["coef"], "lasso": linear.elastic_net_of(n, g, l1), "elastic_net": linear.elastic_net_of(n, g, *mixed)}


def variance_inflation(df: DataFrame, x: str) -> np.ndarray:
    """Of each element, auxiliary regressions without a constant."""
    _, g = moments(df, x)
    return np.array(linear.vif_of(g[1:, 1:]))


def independent(df: DataFrame, x: str, most: float = 10.0) -> list[int]:
    """Elements left after dropping the most inflated until all are below ``most``."""
    _, g = moments(df, x)
    return linear.independent(g[1:, 1:], most)


def _newton(step: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], at: np.ndarray, valid: Callable[[np.ndarray], bool], rounds: int, tol: float, what: str) -> np.ndarray:
    """Maximise a concave mean: ``step`` gives value, gradient and Hessian; a step that lowers the value is halved."""
    value, grad, hess = step(at)
    done = 1
    while np.abs(grad).max() >= tol and done < rounds:
        move, size = np.linalg.solve(1e-12 * np.eye(len(at)) - hess, grad), 1.0
        while size > 1e-10:
            new = at + size * move
            if valid(new):
                found, done = step(new), done + 1
                if found[0] >= value - 1e-13 * (1 + abs(value)):
                    break
            size /= 2
        else:
            break
        at, (value, grad, hess) = new, found
    if np.abs(grad).max() >= tol:
        warnings.warn(f"{what} stopped after {done} passes at a gradient of {np.abs(grad).max():.1e}", stacklevel=3)
    return at


def binary_model(df: DataFrame, x: str, y: Column, *, link: str = "logit", l2: float = 1.0, rounds: int = 60, tol: float = 1e-9) -> np.ndarray:
    """Coefficients, the constant first, of a binary regression; ``link``: logit or cloglog.

    Maximises the log-likelihood less ``l2 / 2`` times the squared slopes by Newton steps: one pass a step.
    """
    if link not in ("logit", "cloglog"):
        raise ValueError("link must be logit or cloglog")
    dim = width(df, x)
    d, k = complete(df, x, [y], dim), dim + 1

    def sums(b: np.ndarray) -> Callable[..., np.ndarray]:
        def f(v: np.ndarray, t: np.ndarray) -> np.ndarray:
            z = np.column_stack([np.ones(len(v)), v])
            eta = z @ b
            if link == "logit":
                p = 1 / (1 + np.exp(-eta))
                value, slope, bend = (t * eta - np.logaddexp(0, eta)).sum(), t - p, -p * (1 - p)
            else:  # log(1 - exp(-m)) for a one, -m for a zero, m = exp(eta)
                m = np.exp(np.clip(eta, -700, 30))
                e = np.exp(-m)
                q = np.maximum(-np.expm1(-m), 1e-300)
                one = m * e / q
                value = np.where(t > 0.5, np.log(q), -m).sum()
                slope = np.where(t > 0.5, one, -m)
                bend = np.where(t > 0.5, one * (1 - m - one), -m)
            return np.concatenate([[len(v), value], z.T @ slope, ((z.T * bend) @ z).ravel()])

        return f

    penalty = np.concatenate([[0.0], np.full(dim, l2)])

    def step(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = summed(d, sums(b), dim, 2 + k + k * k)
        n = max(1.0, s[0])
        return (s[1] - (penalty * b**2).sum() / 2) / n, (s[2 : 2 + k] - penalty * b) / n, (s[2 + k :].reshape(k, k) - np.diag(penalty)) / n

    return _newton(step, np.zeros(k), lambda b: True, rounds, tol, "binary_model")


def ordered_model(df: DataFrame, x: str, y: Column, classes: int, *, l2: float = 1e-3, rounds: int = 60, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and increasing cut-points of proportional odds for labels 0 to ``classes - 1``.

    ``P(y <= c) = 1 / (1 + exp(-(cut_c - x slope)))``; the mean log-likelihood less ``l2 / 2`` times the squared slopes.
    """
    dim, m = width(df, x), classes - 1
    d, k = complete(df, x, [y], dim), dim + classes - 1

    def sums(at: np.ndarray) -> Callable[..., np.ndarray]:
        cuts, b = np.concatenate([[-np.inf], at[:m], [np.inf]]), at[m:]

        def f(v: np.ndarray, t: np.ndarray) -> np.ndarray:
            c = t.astype(int)
            eta = v @ b
            high, low = np.clip(cuts[c + 1] - eta, -700, 700), np.clip(cuts[c] - eta, -700, 700)
            fh, fl = 1 / (1 + np.exp(-high)), 1 / (1 + np.exp(-low))
            p = np.maximum(np.where(c == 0, fh, np.where(c == m, 1 / (1 + np.exp(low)), fh * (1 - fl) * -np.expm1(np.minimum(low - high, 0)))), 1e-300)
            ah, al = fh * (1 - fh), fl * (1 - fl)
            gh, gl = ah / p, -al / p  # slopes of log p by the upper and the lower bound
            hh, ll, hl = ah * (1 - 2 * fh) / p - gh**2, -al * (1 - 2 * fl) / p - gl**2, -gh * gl
            # Bounds as rows of a design: a cut-point each, less the vector.
            up = np.column_stack([c[:, None] == np.arange(m), -v]).astype(float)
            down = np.column_stack([c[:, None] - 1 == np.arange(m), -v]).astype(float)
            up[c == m] = 0
            down[c == 0] = 0
            cross = (up.T * hl) @ down
            return np.concatenate([[len(v), np.log(p).sum()], up.T @ gh + down.T @ gl, ((up.T * hh) @ up + (down.T * ll) @ down + cross + cross.T).ravel()])

        return f

    penalty = np.concatenate([np.zeros(m), np.full(dim, l2)])

    def step(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = summed(d, sums(at), dim, 2 + k + k * k)
        n = max(1.0, s[0])
        return s[1] / n - (penalty * at**2).sum() / 2, s[2 : 2 + k] / n - penalty * at, s[2 + k :].reshape(k, k) / n - np.diag(penalty)

    start = np.concatenate([np.log((np.arange(m) + 1) / (classes - np.arange(m) - 1)), np.zeros(dim)])
    at = _newton(step, start, lambda a: bool((np.diff(a[:m]) > 0).all()), rounds, tol, "ordered_model")
    return at[m:], at[:m]


def ordered_probabilities(df: DataFrame, x: str, slopes: np.ndarray, cuts: np.ndarray, out: str = "probabilities") -> DataFrame:
    """An array of each class's probability; null where the vector is."""
    eta = product(x, np.zeros(len(slopes)), slopes[:, None])[0]
    below = [1 / (1 + F.exp(F.col("_eta") - float(c))) for c in cuts]
    parts = [below[0], *[b - a for a, b in zip(below, below[1:], strict=False)], 1 - below[-1]]
    return df.withColumn("_eta", eta).withColumn(out, F.when(F.col("_eta").isNotNull(), F.array(*parts))).drop("_eta")
