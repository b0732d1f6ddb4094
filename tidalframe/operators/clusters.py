"""Clusters of a bounded set of shapes, such as the years of a seasonal series: Ward's tree, a k-means scan by silhouettes, and how unusual each member is.

Sets are groups of a table, one a task; what grows is the number of sets. A set
of more than ``MOST`` members raises an error: a tree over more is not a summary.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Members of a set.
MOST = 5000


def shapes(df: DataFrame, keys: list[str], part: Column, value: str, parts: int) -> DataFrame:
    """``shape``: each key's shares of its own total over parts 1 to ``parts`` (0 where it has none); keys without a positive total are left out."""
    g = df.groupBy(*keys).agg(F.sum(value).alias("_all"), *[F.coalesce(F.sum(F.when(part == p, F.col(value))), F.lit(0.0)).alias(f"_p{p}") for p in range(1, parts + 1)])
    return g.where(F.col("_all") > 0).select(*keys, F.array(*[F.col(f"_p{p}") / F.col("_all") for p in range(1, parts + 1)]).alias("shape"))


def ward(x: np.ndarray) -> np.ndarray:
    """Merges by Ward's criterion as rows ``left, right, height, size``: clusters are numbered from the points on, in order of height.

    Nearest-neighbour chains: quadratic in the points. A height is the root of
    twice the growth of the sum of squares, so that of two points is their distance.
    """
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(2) if n else np.zeros((0, 0))
    np.fill_diagonal(d, np.inf)
    size, alive, found, chain = np.ones(n), np.ones(n, bool), [], []
    while len(found) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            row = d[chain[-1]]
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]  # a tie goes back, or chains would circle
                break
            chain.append(near)
        a, b = chain.pop(), chain.pop()
        keep, gone = min(a, b), max(a, b)
        found.append((keep, gone, d[a, b]))
        both = size[a] + size[b]
        merged = ((size + size[a]) * d[a] + (size + size[b]) * d[b] - size * d[a, b]) / (size + both)
        size[keep], alive[gone] = both, False
        d[keep], d[:, keep] = merged, merged
        d[keep, keep] = np.inf
        d[gone], d[:, gone] = np.inf, np.inf
        d[keep, ~alive] = d[~alive, keep] = np.inf
    label, out = {}, []
    many = {k: 1 for k in range(n)}
    for k, (a, b, h) in enumerate(sorted(found, key=lambda m: m[2])):
        a, b = _last(label, a), _last(label, b)
        low, high = min(a, b), max(a, b)
        many[n + k] = many[low] + many[high]
        out.append((low, high, float(np.sqrt(max(h, 0.0))), many[n + k]))
        label[a] = label[b] = n + k
    return np.array(out, float).reshape(-1, 4)


def _last(label: dict[int, int], k: int) -> int:
    while k in label:
        k = label[k]
    return k


def cut_tree(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels of the ``k`` clusters that are left before the last ``k - 1`` merges, numbered by first member."""
    label: dict[int, int] = {}
    for j in range(max(0, n - k)):
        label[int(merges[j, 0])] = label[int(merges[j, 1])] = n + j
    roots = [_last(label, i) for i in range(n)]
    order = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots], int)


def silhouettes(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Euclidean: distance to the nearest other cluster less that to one's own, over the larger; 0 alone in a cluster."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups = np.unique(label)
    mine = label[:, None] == groups
    total, many = d @ mine, mine.sum(0)
    own = (total * mine).sum(1) / np.maximum((many * mine).sum(1) - 1, 1)
    other = np.where(mine, np.inf, total / many).min(1) if len(groups) > 1 else np.full(len(x), np.nan)
    top = np.maximum(own, other)
    return np.where((many * mine).sum(1) == 1, 0.0, np.where(top > 0, (other - own) / np.where(top > 0, top, 1), 0.0))


def k_means(x: np.ndarray, k: int, seed: int = 0, starts: int = 10, rounds: int = 100) -> np.ndarray:
    """Labels of the best of several seeded runs, numbered by first member."""
    best, least = None, np.inf
    for s in range(starts):
        rng = np.random.default_rng((seed, k, s))
        centers = x[[rng.integers(len(x))]]
        while len(centers) < k:
            near = ((x[:, None] - centers[None]) ** 2).sum(2).min(1)
            centers = np.vstack([centers, x[rng.choice(len(x), p=near / near.sum()) if near.sum() > 0 else rng.integers(len(x))]])
        for _ in range(rounds):
            d = ((x[:, None] - centers[None]) ** 2).sum(2)
            label = d.argmin(1)
            new = np.array([x[label == j].mean(0) if (label == j).any() else x[d.min(1).argmax()] for j in range(k)])
            if np.allclose(new, centers):
                break
            centers = new
        cost = d.min(1).sum()
        if cost < least - 1e-12:
            best, least = label, cost
    order = {r: i for i, r in enumerate(dict.fromkeys(best.tolist()))}
    return np.array([order[r] for r in best.tolist()], int)


def _points(pdf: pd.DataFrame, name: str, shape: str) -> tuple[list[str], np.ndarray]:
    if len(pdf) > MOST:
        raise ValueError(f"a set of more than {MOST} members")
    d = pdf.sort_values(name)
    x = np.array(d[shape].tolist(), float)
    sd = x.std(0)
    return d[name].astype(str).tolist(), (x - x.mean(0)) / np.where(sd > 0, sd, 1)


def trees(df: DataFrame, key: str, name: str, shape: str) -> DataFrame:
    """``key, step, left, right, height, size``: Ward's merges over each set's standardised shapes, members in order of name."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = ward(_points(pdf, name, shape)[1])
        return pd.DataFrame({"_key": str(pdf[key].iloc[0]), "step": np.arange(1, len(m) + 1), "left": m[:, 0].astype(int), "right": m[:, 1].astype(int), "height": m[:, 2], "size": m[:, 3].astype(int)})

    out = df.select(key, name, shape).groupBy(key).applyInPandas(run, "_key string, step int, left int, right int, height double, size int")
    return out.withColumnRenamed("_key", key)


def scan(df: DataFrame, key: str, name: str, shape: str, *, most: int = 6, seed: int = 0) -> DataFrame:
    """``key, name, k, score, cluster, silhouette, nearest, distance, unusual`` of each member: ``k`` (2 to ``most``, fewer than
    the members) has the highest mean silhouette ``score`` (ties: the smallest), ``unusual`` is the share of members whose mean
    distance to the others is smaller. Sets of fewer than three members are left out.
    """
    columns = ["_key", "_name", "k", "score", "cluster", "silhouette", "nearest", "distance", "unusual"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x = _points(pdf, name, shape)
        n = len(names)
        if n < 3:
            return pd.DataFrame(columns=columns)
        tried = {k: k_means(x, k, seed) for k in range(2, min(most, n - 1) + 1)}
        scores = {k: float(silhouettes(x, label).mean()) for k, label in tried.items()}
        k = max(scores, key=lambda j: (round(scores[j], 12), -j))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        far = d.sum(1) / (n - 1)
        np.fill_diagonal(d, np.inf)
        near = d.argmin(1)
        return pd.DataFrame({"_key": str(pdf[key].iloc[0]), "_name": names, "k": k, "score": scores[k], "cluster": tried[k], "silhouette": silhouettes(x, tried[k]), "nearest": [names[j] for j in near], "distance": d.min(1), "unusual": (far[None, :] < far[:, None] - 1e-12).mean(1)})

    out = df.select(key, name, shape).groupBy(key).applyInPandas(run, "_key string, _name string, k int, score double, cluster int, silhouette double, nearest string, distance double, unusual double")
    return out.withColumnsRenamed({"_key": key, "_name": name})


def labelled_silhouettes(df: DataFrame, key: str, name: str, label: str, shape: str) -> DataFrame:
    """``key, name, silhouette`` for given labels, by joining a set's members (of a bounded set, as above)."""
    a = df.select(key, F.col(name).alias("_a"), F.col(label).alias("_la"), F.col(shape).alias("_xa"))
    b = df.select(key, F.col(name).alias("_b"), F.col(label).alias("_lb"), F.col(shape).alias("_xb"))
    gap = F.sqrt(F.aggregate(F.zip_with("_xa", "_xb", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    means = a.join(b, key).where("_a <> _b").groupBy(key, "_a", "_la", "_lb").agg(F.avg(gap).alias("_d"))
    w = Window.partitionBy(key, "_a")
    own, other = F.max(F.when(F.col("_la") == F.col("_lb"), F.col("_d"))).over(w), F.min(F.when(F.col("_la") != F.col("_lb"), F.col("_d"))).over(w)
    value = F.when(own.isNull(), F.lit(0.0)).otherwise((other - own) / F.greatest(own, other))
    return means.select(key, F.col("_a").alias(name), value.alias("silhouette")).distinct()
