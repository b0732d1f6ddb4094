"""Compositions of the operators beside it: retained components, seasonal systems, stored models, long study tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from . import linear


def component_composites(df: DataFrame, xs: list[str], anchor: str | None = None) -> DataFrame:
    """``kaiser, opposed`` beside the columns: composites of principal components.

    ``kaiser`` adds the scores of components with an eigenvalue over one (the
    first at least), weighted by their shares among those. ``opposed`` is the
    first component whose loadings differ in sign, the first column's being
    positive; null if there is none. A null column gives nulls.
    """
    model = linear.pca(df, xs, len(xs), anchor)
    kept = [j for j, v in enumerate(model["values"]) if v > 1 or j == 0]
    shares = model["share"][kept] / model["share"][kept].sum()
    opposed = next((j for j in range(len(xs)) if model["loadings"][:, j].min() < -1e-9 and model["loadings"][:, j].max() > 1e-9), None)
    out = linear.project(df, model, "_pc")
    total = sum((F.col(f"_pc{j + 1}") * float(s) for j, s in zip(kept, shares, strict=True)), F.lit(0.0))
    side = 1.0 if opposed is None or model["loadings"][0, opposed] >= 0 else -1.0
    other = F.lit(None).cast("double") if opposed is None else F.col(f"_pc{opposed + 1}") * side
    return out.withColumns({"kaiser": total, "opposed": other}).drop(*[f"_pc{j + 1}" for j in range(len(xs))])


def lagged_design(df: DataFrame, key: str, order: str, scores: list[str], y: str) -> DataFrame:
    """Scores and target of the row before, with the target: what a one-step model may see."""
    w = W.by(key, order)
    return df.select(key, order, y, *[F.lag(c).over(w).alias(f"{c}_lag") for c in [*scores, y]])


def largest(df: DataFrame, group: str, name: str, weight: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the largest absolute weight, ``place`` from 1; ties by name, nulls left out."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.abs(F.col(weight))), name))
    return df.where(F.col(weight).isNotNull()).withColumn("place", place).where(F.col("place") <= k)


def by_prefix(df: DataFrame, keys: list[str], sep: str = "_") -> DataFrame:
    """Wide columns summed by the part of their name before ``sep``; a null counts as zero."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        if c not in keys:
            groups.setdefault(c.split(sep)[0], []).append(c)
    return df.select(*keys, *[sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in cs), F.lit(0.0)).alias(g) for g, cs in groups.items()])


def posterior_interval(df: DataFrame, key: str, x: str, mean: float = 57.0, var: float = 180.0, noise: float = 120.0) -> DataFrame:
    """``mean, sd, low, high`` a key: the conjugate normal posterior and its 95 percent interval within [0, 100].

    Fixed values of the defaults: prior mean 57, prior variance 180, noise variance 120; 1.96 deviations.
    """
    v = 1 / (1 / F.lit(var) + F.count(x) / F.lit(noise))
    g = df.groupBy(key).agg(v.alias("_v"), ((F.lit(mean / var) + F.coalesce(F.sum(x), F.lit(0.0)) / noise) * v).alias("mean"))
    half = 1.96 * F.sqrt("_v")
    return g.select(key, "mean", F.sqrt("_v").alias("sd"), F.greatest(F.lit(0.0), F.col("mean") - half).alias("low"), F.least(F.lit(100.0), F.col("mean") + half).alias("high"))


def seasonal_var(df: DataFrame, key: str, order: str, cols: list[str], season: Column, most: int = 12, lags: int | None = None) -> dict:
    """``lags, coef, aic`` of a system with a constant for each season, one row of ``coef`` an equation.

    Constants are swept out by subtracting each season's mean from both sides,
    so only the lags are solved for. Without ``lags`` the number up to ``most``
    with the least AIC is taken; all are compared on the rows that the longest has.
    """
    w, longest = W.by(key, order), lags or most
    wide = df.select(season.alias("_season"), *cols, *[F.lag(c, j).over(w).alias(f"_{c}_{j}") for j in range(1, longest + 1) for c in cols])
    names = [*cols, *[f"_{c}_{j}" for j in range(1, longest + 1) for c in cols]]
    wide = wide.dropna(subset=names)
    within = Window.partitionBy("_season")
    n, g = linear.gram(wide.select(*[(F.col(c) - F.avg(c).over(within)).alias(c) for c in names]), [F.col(c) for c in names])
    k, best = len(cols), None
    for p in [lags] if lags else range(1, most + 1):
        at = slice(k, k + k * p)
        coef = np.linalg.pinv(g[at, at]) @ g[at, :k]
        resid = (g[:k, :k] - g[:k, at] @ coef) / max(n, 1)
        aic = float(np.linalg.slogdet(resid)[1]) + 2 * k * (k * p) / n if n and np.linalg.det(resid) > 0 else math.inf
        if best is None or aic < best["aic"]:
            best = {"lags": p, "coef": coef.T, "aic": aic}
    return best


def save_linear(spark: SparkSession, model: dict, xs: list[str], path: str) -> None:
    """A fitted linear model as a table ``term, coef`` in Parquet: readable by any engine, no object graph."""
    rows = [(t, float(c)) for t, c in zip(["(intercept)", *xs], model["coef"], strict=True)]
    spark.createDataFrame(rows, "term string, coef double").coalesce(1).write.mode("overwrite").parquet(path)


def score_saved(df: DataFrame, path: str, out: str = "score") -> DataFrame:
    """``df`` scored by a stored model; a null term gives null."""
    terms = {r["term"]: r["coef"] for r in df.sparkSession.read.parquet(path).collect()}
    total = F.lit(terms.pop("(intercept)", 0.0))
    for t, c in terms.items():
        total = total + F.col(t) * c
    return df.withColumn(out, total)


def study(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """``key, part, measure, value``: one-row-a-key results of several operators as one long table."""
    out = None
    for part, df in parts.items():
        measures = [c for c in df.columns if c != key]
        long = df.select(key, F.lit(part).alias("part"), F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in measures]), F.array(*[F.col(m).cast("double") for m in measures]))).alias("measure", "value"))
        out = long if out is None else out.unionByName(long)
    return out
