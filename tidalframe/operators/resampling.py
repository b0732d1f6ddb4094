"""Resampling of whole series, fanned out.

A series becomes one row of arrays (of at most ``MOST_ROWS`` values; more raise
an error), and draws are dealt to tasks as (series, chunk): nothing passes
through the driver, and a draw depends on the seed, the series and its number
only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state_space import MOST_ROWS


def held(df: DataFrame, key: str, order: str, *xs: str | Column) -> DataFrame:
    """``key`` (as a string) and arrays ``x0, x1...`` in order; rows with a null or NaN among the values are left out."""
    cols = [(F.col(x) if isinstance(x, str) else x).cast("double").alias(f"x{k}") for k, x in enumerate(xs)]
    d = df.select(F.col(key).cast("string").alias(key), F.col(order).alias("_o"), *cols)
    for k in range(len(xs)):
        d = d.where(F.col(f"x{k}").isNotNull() & ~F.isnan(f"x{k}"))
    g = d.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_o", *[f"x{k}" for k in range(len(xs))]))).alias("_s"))
    size = F.when(F.size("_s") > MOST_ROWS, F.raise_error(F.lit(f"a series of more than {MOST_ROWS} rows")).cast("int")).otherwise(F.size("_s"))
    return g.select(key, size.alias("n"), *[F.col("_s")[f"x{k}"].alias(f"x{k}") for k in range(len(xs))])


def generator(seed: int, key: str, chunk: int) -> np.random.Generator:
    return np.random.default_rng((seed, zlib.crc32(str(key).encode()), chunk))


def draws(series: DataFrame, key: str, total: int, f: Callable[..., np.ndarray], *, chunk: int = 100, seed: int = 0, arrays: int = 1) -> DataFrame:
    """``key, draw, value``: for each series ``total`` values of ``f(generator, how many, x0, ...)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n = min(chunk, total - row.part * chunk)
                values = f(generator(seed, row[0], row.part), n, *[np.asarray(getattr(row, f"x{k}"), float) for k in range(arrays)])
                yield pd.DataFrame({key: row[0], "draw": np.arange(n) + row.part * chunk, "value": values})

    parts = series.select(key, *[f"x{k}" for k in range(arrays)], F.explode(F.sequence(F.lit(0), F.lit(-(-total // chunk) - 1))).alias("part"))
    return parts.repartition(key, "part").mapInPandas(run, f"{key} string, draw int, value double")


def block_bootstrap(df: DataFrame, key: str, order: str, x: str, *, block: int, replicates: int, seed: int = 0) -> DataFrame:
    """``key, n, low, high``: the 2.5 and 97.5 percent points of the mean over moving blocks."""

    def means(rng: np.random.Generator, many: int, v: np.ndarray) -> np.ndarray:
        n = len(v)
        starts = rng.integers(0, max(1, n - block + 1), (many, -(-n // block)))
        return v[(starts[:, :, None] + np.arange(block)).reshape(many, -1)[:, :n] % n].mean(1)

    found = draws(held(df, key, order, x), key, replicates, means, seed=seed)
    return found.groupBy(key).agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))


def _correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of ``a`` with ``b``; 0 where one is constant."""
    a, b = a - a.mean(-1, keepdims=True), b - b.mean()
    size = np.sqrt((a * a).sum(-1) * (b * b).sum())
    return np.where(size > 0, (a * b).sum(-1) / np.where(size > 0, size, 1), 0.0)


def surrogate_test(df: DataFrame, key: str, order: str, x: str, y: str, *, surrogates: int = 200, seed: int = 0) -> DataFrame:
    """``key, corr, p``: correlation of two series, and the share of phase-randomised copies of ``x`` that correlate as much with ``y``."""

    def spun(rng: np.random.Generator, many: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        f = np.fft.rfft(a - a.mean())
        phase = rng.uniform(0, 2 * math.pi, (many, len(f)))
        phase[:, 0] = 0
        return np.abs(_correlation(np.fft.irfft(np.abs(f) * np.exp(1j * phase), len(a)), b))

    series = held(df, key, order, x, y).where("n > 2")
    found = draws(series, key, surrogates, spun, seed=seed, arrays=2)
    real = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(F.coalesce(F.corr(x, y), F.lit(0.0)).alias("corr"))
    return found.join(real, key).groupBy(key).agg(F.first("corr").alias("corr"), ((F.sum((F.col("value") >= F.abs("corr")).cast("int")) + 1) / (F.count("*") + 1)).alias("p"))


def roll_leak_test(df: DataFrame, key: str, order: str, ret: str, roll: Column, *, permutations: int = 2000, seed: int = 0) -> DataFrame:
    """``key, rolls, others, on_rolls, random, p, leak``: is the mean absolute return of roll days larger than that of as many other days?

    Random days are drawn without replacement (with, where there are fewer others
    than rolls). If all choices of days are at most ``permutations``, each is taken
    once and ``p`` is exact. A key without rolls or without other days is left out.
    """
    size = F.abs(F.col(ret))
    d = df.withColumn("_on", F.coalesce(roll, F.lit(False)))
    series = held(d, key, order, size, F.col("_on").cast("int"))
    split = series.select(key, F.transform(F.filter(F.arrays_zip("x0", "x1"), lambda s: s["x1"] == 1), lambda s: s["x0"]).alias("x0"), F.transform(F.filter(F.arrays_zip("x0", "x1"), lambda s: s["x1"] == 0), lambda s: s["x0"]).alias("x1"))
    split = split.where((F.size("x0") > 0) & (F.size("x1") > 0))

    def means(rng: np.random.Generator, many: int, on: np.ndarray, others: np.ndarray) -> np.ndarray:
        k, n = len(on), len(others)
        if n < k:
            return others[rng.integers(0, n, (many, k))].mean(1)
        return np.array([others[rng.permutation(n)[:k]].mean() for _ in range(many)])

    def choices(pdf: pd.DataFrame) -> pd.DataFrame:
        on, others = (np.asarray(pdf[c].iloc[0], float) for c in ("x0", "x1"))
        return pd.DataFrame({key: pdf[key].iloc[0], "draw": 0, "value": [others[list(c)].mean() for c in combinations(range(len(others)), len(on))]})

    # ln of the number of choices, from factorials: whether all can be taken.
    log_factorial = F.udf(lambda n: math.lgamma(n + 1), "double")
    k, n = F.size("x0"), F.size("x1")
    few = (n >= k) & (log_factorial(n) - log_factorial(k) - log_factorial(F.greatest(n - k, F.lit(0))) <= math.log(permutations) + 1e-9)
    split = split.withColumn("_few", few)
    drawn = draws(split.where("not _few"), key, permutations, means, seed=seed, arrays=2)
    whole = split.where("_few").groupBy(key).applyInPandas(choices, f"{key} string, draw int, value double")
    mean = F.aggregate("x0", F.lit(0.0), lambda s, v: s + v) / k
    facts = split.select(key, k.cast("long").alias("rolls"), n.cast("long").alias("others"), mean.alias("on_rolls"))
    # Sums of the same days in another order are no difference.
    p = F.avg((F.col("value") >= F.col("on_rolls") * (1 - 1e-12)).cast("double"))
    out = drawn.unionByName(whole).join(facts, key).groupBy(key, "rolls", "others", "on_rolls").agg(F.avg("value").alias("random"), p.alias("p"))
    return out.withColumn("leak", F.col("p") < 0.05)
