"""Staged evaluation of linear models: expanding cross-validation inside the training rows, a held-out test, and the refit.

All expanding fits of a series come from running sums of products: one pass and
one small solve a row, no refit reads a row twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .arima import MOST_ROWS


def expanding_fits(x: np.ndarray, y: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Coefficients (the constant first, not penalised) fitted on the rows before each row and, last, on all."""
    z = np.column_stack([np.ones(len(x)), x])
    k = z.shape[1]
    gram = np.concatenate([np.zeros((1, k, k)), np.cumsum(z[:, :, None] * z[:, None, :], axis=0)])
    right = np.concatenate([np.zeros((1, k)), np.cumsum(z * y[:, None], axis=0)])
    gram = gram + ridge * np.diag([0.0] + [1.0] * (k - 1))
    return np.stack([np.linalg.lstsq(g, r, rcond=1e-12)[0] for g, r in zip(gram, right, strict=True)])


def n_splits(n: int, least: int, step: int = 1, ahead: int = 1) -> int:
    """Folds of an expanding cross-validation of ``n`` rows."""
    return max(0, (n - ahead - least) // step + 1)


def staged_evaluation(df: DataFrame, key: str, order: str, y: str, xs: list[str], *, test: float = 0.25, least: int = 60, step: int = 1, ridge: float = 0.0, most: float = 1.5) -> DataFrame:
    """``key, stage, n, rmse, mae, naive_rmse, direction, ratio, passed, coef``, a row for each of ``cv``, ``test`` and ``refit``.

    ``cv``: each ``step``-th row of the training rows from the ``least``-th on, forecast from the rows before it
    (``n`` is then ``n_splits``). ``test``: the last ``test`` share of a series' complete rows, forecast by the fit on the
    others. ``refit``: coefficients on all rows. The naive forecast is the last value. ``passed``: the test's error is less than
    ``most`` times that of the cross-validation (true where there is none: fewer than ``least + 5`` training rows).
    """
    columns = ["_key", "stage", "n", "rmse", "mae", "naive_rmse", "direction", "ratio", "passed", "coef"]

    def scores(actual: np.ndarray, guess: np.ndarray, before: np.ndarray) -> list[float]:
        e, naive = actual - guess, actual - before
        moved = naive != 0
        right = np.sign(guess - before) == np.sign(naive)
        return [len(e), float(np.sqrt((e**2).mean())), float(np.abs(e).mean()), float(np.sqrt((naive**2).mean())), float(right[moved].mean()) if moved.any() else np.nan]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.dropna(subset=[y, *xs]).sort_values(order)
        if len(d) > MOST_ROWS:
            raise ValueError(f"a series of more than {MOST_ROWS} rows")
        v, x = d[y].to_numpy(float), d[xs].to_numpy(float)
        n = len(v)
        split = n - int(n * test)
        if split < len(xs) + 2 or split == n:
            return pd.DataFrame(columns=columns)
        fits, z = expanding_fits(x, v, ridge), np.column_stack([np.ones(n), x])
        rows, cv = [], np.nan
        at = np.arange(least, split, step)
        if split >= least + 5:
            s = scores(v[at], (z[at] * fits[at]).sum(axis=1), v[at - 1])
            cv = s[1]
            rows.append(["cv", *s, np.nan, None, None])
        s = scores(v[split:], z[split:] @ fits[split], v[split - 1 : -1])
        ratio = s[1] / cv if cv > 0 else np.nan
        rows.append(["test", *s, ratio, bool(np.isnan(ratio) or ratio < most), fits[split].tolist()])
        rows.append(["refit", n, *[np.nan] * 5, None, fits[n].tolist()])
        return pd.DataFrame([[d[key].iloc[0], *r] for r in rows], columns=columns)

    kinds = f"_key {df.schema[key].dataType.simpleString()}, stage string, n long, rmse double, mae double, naive_rmse double, direction double, ratio double, passed boolean, coef array<double>"
    return df.select(key, order, y, *xs).groupBy(key).applyInPandas(run, kinds).withColumnRenamed("_key", key)
