"""Walk-forward probabilities with calibration inside each fold.

A fold is fitted on rows that end ``embargo`` before it: the rows are split in
three, stratified; a ridge logit is fitted on two parts and a sigmoid (Platt) on
its scores of the third; the fold's probability is the mean of the three. A
series is one row of arrays, and its folds are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state_space import MOST_ROWS


def logit(x: np.ndarray, t: np.ndarray, l2: float, rounds: int = 100) -> np.ndarray:
    """Constant and slopes that minimise the summed log-loss and ``l2 / 2`` times the squared slopes."""
    z, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    pen = np.concatenate([[0.0], np.full(x.shape[1], l2)])
    loss = lambda c: np.logaddexp(0, z @ c).sum() - t @ (z @ c) + (pen * c * c).sum() / 2
    now = loss(b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -700, 700)))
        move = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(pen + 1e-12), z.T @ (t - p) - pen * b)
        size = 1.0
        while loss(b + size * move) > now + 1e-12 * abs(now) and size > 1e-8:
            size /= 2
        b = b + size * move
        now = loss(b)
        if np.abs(size * move).max() < 1e-9:
            break
    return b


def platt(score: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """``p = 1 / (1 + exp(a score + b))`` against smoothed targets, by Newton steps."""
    ones, n = t.sum(), len(t)
    target = np.where(t > 0, (ones + 1) / (ones + 2), 1 / (n - ones + 2))
    # A logit with fractional targets: no penalty, the same concave likelihood.
    b = logit(score[:, None], target, 0.0)
    return -float(b[1]), -float(b[0])


def stratified(t: np.ndarray, parts: int = 3) -> np.ndarray:
    """Each row's part: classes in runs of rows, as even over the parts as the sorted labels dealt one by one."""
    order = np.sort(t)
    out = np.zeros(len(t), int)
    for c in np.unique(t):
        share = [(order[k::parts] == c).sum() for k in range(parts)]
        out[np.flatnonzero(t == c)] = np.repeat(np.arange(parts), share)
    return out


def fit(x: np.ndarray, t: np.ndarray, l2: float, parts: int = 3) -> list[tuple[np.ndarray, float, float]]:
    """A logit and its sigmoid for each part that is held out; none if a class has fewer rows than parts."""
    if min((t == 0).sum(), (t == 1).sum()) < parts:
        return []
    part = stratified(t, parts)
    out = []
    for k in range(parts):
        b = logit(x[part != k], t[part != k], l2)
        out.append((b, *platt(b[0] + x[part == k] @ b[1:], t[part == k])))
    return out


def predict(model: list[tuple[np.ndarray, float, float]], x: np.ndarray) -> np.ndarray:
    return np.mean([1 / (1 + np.exp(np.clip(a * (b[0] + x @ b[1:]) + c, -700, 700))) for b, a, c in model], 0)


def walk_forward(df: DataFrame, key: str, order: str, y: str, xs: list[str], *, least: int = 156, step: int = 13, embargo: int = 4, l2: float = 2.0) -> DataFrame:
    """``key, order, y, p``: rows from the ``least``-th on, each forecast by a fit on rows at least ``embargo`` before its fold of ``step`` rows.

    Rows with a null are left out before they are counted; folds whose training
    rows have one class, or are fewer than half of ``least``, give none.
    """
    good = df.select(F.col(key).cast("string").alias("_key"), F.col(order).alias("_o"), F.col(y).cast("double").alias("_y"), F.array(*[F.col(x).cast("double") for x in xs]).alias("_x")).where("_y is not null").where(~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    g = good.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_o", "_y", "_x"))).alias("_s")).withColumn("_n", F.size("_s"))
    g = g.withColumn("_n", F.when(F.col("_n") > MOST_ROWS, F.raise_error(F.lit(f"a series of more than {MOST_ROWS} rows")).cast("int")).otherwise(F.col("_n"))).where(F.col("_n") > least)
    folds = g.withColumn("_first", F.explode(F.sequence(F.lit(least), F.col("_n") - 1, F.lit(step))))
    # A fold carries its own past and its own rows only.
    past, own = F.slice("_s", F.lit(1), F.greatest(F.col("_first") - embargo, F.lit(0))), F.slice("_s", F.col("_first") + 1, F.lit(step))
    folds = folds.select("_key", "_first", past["_y"].alias("ty"), F.flatten(past["_x"]).alias("tx"), own["_o"].alias("o"), own["_y"].alias("vy"), F.flatten(own["_x"]).alias("vx"))
    k = len(xs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                t, x = np.asarray(row.ty, float), np.asarray(row.tx, float).reshape(-1, k)
                model = fit(x, t, l2) if len(t) >= least // 2 and len(set(t.tolist())) == 2 else []
                if model:
                    yield pd.DataFrame({"_key": row[0], "_o": list(row.o), "_y": list(row.vy), "p": predict(model, np.asarray(row.vx, float).reshape(-1, k))})

    kinds = f"_key string, _o {df.schema[order].dataType.simpleString()}, _y double, p double"
    return folds.repartition("_key", "_first").mapInPandas(run, kinds).withColumnsRenamed({"_key": key, "_o": order, "_y": y})


def scores(found: DataFrame, key: str, y: str, p: str = "p") -> DataFrame:
    """``key, n, base_rate, auc, log_loss, brier`` of forecasts; the area by mid ranks inside a key (null with one class)."""
    w = Window.partitionBy(key).orderBy(p)
    ties = Window.partitionBy(key, p)
    rank = F.rank().over(w) + (F.count("*").over(ties) - 1) / 2
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    d = found.withColumn("_r", rank).withColumn("_l", -F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q)))
    n, ones = F.count("*"), F.sum(y)
    auc = F.when((ones > 0) & (ones < n), (F.sum(F.when(F.col(y) == 1, F.col("_r"))) - ones * (ones + 1) / 2) / (ones * (n - ones)))
    return d.groupBy(key).agg(n.alias("n"), F.avg(y).alias("base_rate"), auc.alias("auc"), F.avg("_l").alias("log_loss"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))
