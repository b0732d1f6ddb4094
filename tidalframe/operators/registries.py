"""Functions by name: table transforms, grouped estimators, models with feature sets, and statistics to resample."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from . import resampling

Transform = Callable[[DataFrame, str, str, str], DataFrame]

TRANSFORMS: dict[str, Transform] = {
    "change": lambda d, k, o, x: d.withColumn(x, W.change(x, W.by(k, o))),
    "log": lambda d, k, o, x: d.withColumn(x, F.when(F.col(x) > 0, F.log(x))),
    "z52": lambda d, k, o, x: d.withColumn(x, W.rolling_z(x, W.by(k, o), 52, 26)),
    "clip3": lambda d, k, o, x: d.withColumn(x, F.when(F.col(x).isNotNull(), F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col(x))))),
}


def pipeline(df: DataFrame, names: list[str], key: str, order: str, x: str) -> DataFrame:
    """The named transforms of ``x``, one after the other; an unknown name raises before anything runs."""
    for f in [TRANSFORMS[n] for n in names]:
        df = df.transform(f, key, order, x)
    return df


#: One series (in order) to one number.
ESTIMATORS: dict[str, Callable[[np.ndarray], float]] = {
    "mean": lambda v: float(v.mean()),
    "median": lambda v: float(np.median(v)),
    "trend": lambda v: float(np.polyfit(np.arange(len(v)), v, 1)[0]) if len(v) > 1 else np.nan,
    "persistence": lambda v: float(np.corrcoef(v[1:], v[:-1])[0, 1]) if len(v) > 2 and v.std() > 0 else np.nan,
}


def estimate(df: DataFrame, names: list[str], key: str, order: str, x: str) -> DataFrame:
    """``key, estimator, value``: each named estimator of each series' known values, a series a task."""
    chosen = {n: ESTIMATORS[n] for n in names}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.dropna(subset=[x]).sort_values(order)[x].to_numpy(float)
        return pd.DataFrame({"_key": pdf[key].iloc[0], "estimator": list(chosen), "value": [f(v) if len(v) else np.nan for f in chosen.values()]})

    out = df.select(key, order, x).groupBy(key).applyInPandas(run, f"_key {df.schema[key].dataType.simpleString()}, estimator string, value double")
    return out.select(F.col("_key").alias(key), "estimator", F.when(~F.isnan("value"), F.col("value")).alias("value"))


#: From regressors and response to fitted values.
MODELS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "mean": lambda x, y: np.full(len(y), y.mean()),
    "ols": lambda x, y: (z := np.column_stack([np.ones(len(y)), x])) @ np.linalg.lstsq(z, y, rcond=None)[0],
    "ridge": lambda x, y: y.mean() + (u := x - x.mean(0)) @ np.linalg.solve(u.T @ u + len(y) * np.eye(x.shape[1]), u.T @ (y - y.mean())),
}


def tournament(df: DataFrame, key: str, y: str, models: list[str], sets: dict[str, list[str]]) -> DataFrame:
    """``key, model, features, n, rmse`` of every model on every feature set: a grouped map over (key, model, set)."""
    chosen = {n: MODELS[n] for n in models}
    pairs = [F.struct(F.lit(m).alias("model"), F.lit(s).alias("features")) for m in models for s in sets]
    columns = sorted({c for cols in sets.values() for c in cols})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model, name = pdf["model"].iloc[0], pdf["features"].iloc[0]
        d = pdf.dropna(subset=[y, *sets[name]])
        v = d[y].to_numpy(float)
        e = v - chosen[model](d[sets[name]].to_numpy(float), v) if len(v) else v
        return pd.DataFrame({"_key": [pdf[key].iloc[0]], "model": [model], "features": [name], "n": [len(v)], "rmse": [float(np.sqrt((e**2).mean())) if len(v) else None]})

    each = df.select(key, y, *columns, F.explode(F.array(*pairs)).alias("_p")).select("*", "_p.model", "_p.features").drop("_p")
    out = each.groupBy(key, "model", "features").applyInPandas(run, f"_key {df.schema[key].dataType.simpleString()}, model string, features string, n long, rmse double")
    return out.withColumnRenamed("_key", key)


#: A statistic of resampled rows, and the same as an aggregate of the rows as they are.
STATISTICS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], Callable[[str], Column]]] = {
    "mean": (lambda v: v.mean(1), F.avg),
    "median": (lambda v: np.median(v, 1), lambda x: F.percentile(x, F.lit(0.5))),
    "deviation": (lambda v: v.std(1), F.stddev_pop),
    "highest": (lambda v: v.max(1), F.max),
}


def bootstrap(df: DataFrame, statistic: str, key: str, order: str, x: str, *, draws: int = 400, seed: int = 0) -> DataFrame:
    """``key, observed, low, high``: a named statistic of each series and the 2.5 and 97.5 percent points of its bootstrap."""
    f, observed = STATISTICS[statistic]
    drawn = resampling.draws(resampling.held(df, key, order, x), key, draws, lambda rng, n, v: f(v[rng.integers(0, len(v), (n, len(v)))]), seed=seed)
    real = df.where(F.col(x).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(observed(x).alias("observed"))
    ends = drawn.groupBy(key).agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))
    return real.join(ends, key)
