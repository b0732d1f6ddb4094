"""Model operators on ``pyspark.ml`` and small numpy fits over gathered moments."""

from __future__ import annotations

import itertools
import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear


def tree_scores(df: DataFrame, y: str, x: str, seed: int = 7) -> DataFrame:
    """Out-of-sample errors of a forest and of boosted trees on a vector column (a substitute for other boosting libraries, not their equal)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    d = df.dropna(subset=[y, x]).select(y, array_to_vector(x).alias("features"), (F.pmod(F.xxhash64(x), F.lit(4)) == 0).alias("_test"))
    train, test, out = d.where("not _test"), d.where("_test"), None
    for name, model in (("forest", RandomForestRegressor(labelCol=y, numTrees=20, maxDepth=4, seed=seed)), ("boosted", GBTRegressor(labelCol=y, maxIter=10, maxDepth=3, seed=seed))):
        fit = model.fit(train)
        s = fit.transform(test).agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.sqrt(F.avg((F.col(y) - F.col("prediction")) ** 2)).alias("rmse"))
        out = s if out is None else out.unionByName(s)
    return out


def text_clusters(df: DataFrame, keys: list[str], text: str, k: int, features: int = 200, seed: int = 7) -> DataFrame:
    """Clusters of texts by TF-IDF of words and word pairs."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer

    steps = [
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+"), NGram(n=2, inputCol="_w", outputCol="_p"),
        SQLTransformer(statement="SELECT *, concat(_w, _p) AS _t FROM __THIS__"), CountVectorizer(inputCol="_t", outputCol="_c", vocabSize=features),
        IDF(inputCol="_c", outputCol="_i"), Normalizer(inputCol="_i", outputCol="features"), KMeans(k=k, seed=seed, predictionCol="cluster"),
    ]
    d = df.where(F.col(text).isNotNull())
    return Pipeline(stages=steps).fit(d).transform(d).select(*keys, "cluster")


def ordered_logit(df: DataFrame, y: str, xs: list[str], l2: float = 1e-3, rounds: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Three-class proportional odds: slopes and two cut-points, by Newton steps to a gradient of ``tol`` a row.

    A round is one distributed pass and sends one row of sums to the driver;
    a step that lowers the likelihood is halved. Warns if ``rounds`` end first.
    """
    d = df.select(F.col(y).alias("_y"), *xs).dropna().persist()
    n, k = max(1, d.count()), len(xs)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean log likelihood less the penalty, its gradient and Hessian; cut-points first."""
        eta = linear.predict(at[2:], xs, False)
        z = d.select("*", (float(at[0]) - eta).alias("_z0"), (float(at[1]) - eta).alias("_z1"))
        q = z.select("*", (1 / (1 + F.exp(-F.col("_z0")))).alias("_lo"), (1 / (1 + F.exp(F.col("_z0")))).alias("_lo1"), (1 / (1 + F.exp(-F.col("_z1")))).alias("_hi"), (1 / (1 + F.exp(F.col("_z1")))).alias("_hi1"))
        # hi - lo without cancellation: hi (1 - lo) (1 - exp(cut 0 - cut 1))
        mid = F.col("_hi") * F.col("_lo1") * float(-np.expm1(at[0] - at[1]))
        q = q.select("*", F.greatest(F.when(F.col("_y") == 0, F.col("_lo")).when(F.col("_y") == 1, mid).otherwise(F.col("_hi1")), F.lit(1e-300)).alias("_p"), (F.col("_lo") * F.col("_lo1")).alias("_a"), (F.col("_hi") * F.col("_hi1")).alias("_b"))
        of = lambda c0, c1, c2: F.when(F.col("_y") == 0, c0).when(F.col("_y") == 1, c1).otherwise(c2)
        zero = F.lit(0.0)
        q = q.select("*", of(F.col("_lo1"), -F.col("_a") / F.col("_p"), zero).alias("_g0"), of(zero, F.col("_b") / F.col("_p"), -F.col("_hi")).alias("_g1"))
        q = q.select(
            "*", of(-F.col("_a"), -F.col("_a") * (1 - 2 * F.col("_lo")) / F.col("_p") - F.col("_g0") ** 2, zero).alias("_h00"),
            of(zero, F.col("_b") * (1 - 2 * F.col("_hi")) / F.col("_p") - F.col("_g1") ** 2, -F.col("_b")).alias("_h11"), of(zero, -F.col("_g0") * F.col("_g1"), zero).alias("_h01"),
        )
        s0, s1 = F.col("_h00") + F.col("_h01"), F.col("_h01") + F.col("_h11")
        terms = [F.log("_p"), F.col("_g0"), F.col("_g1"), *[-(F.col("_g0") + F.col("_g1")) * F.col(x) for x in xs], F.col("_h00"), F.col("_h01"), F.col("_h11")]
        terms += [-s0 * F.col(x) for x in xs] + [-s1 * F.col(x) for x in xs] + [(s0 + s1) * F.col(xs[i]) * F.col(xs[j]) for i, j in pairs]
        row = np.array([v or 0.0 for v in q.agg(*[F.sum(t) for t in terms]).first()]) / n
        grad, rest, hess = row[1 : k + 3], row[k + 3 :], np.zeros((k + 2, k + 2))
        hess[0, 0], hess[0, 1], hess[1, 1], hess[0, 2:], hess[1, 2:] = rest[0], rest[1], rest[2], rest[3 : k + 3], rest[k + 3 : 2 * k + 3]
        for (i, j), v in zip(pairs, rest[2 * k + 3 :], strict=True):
            hess[i + 2, j + 2] = v
        hess = np.triu(hess) + np.triu(hess, 1).T
        pen = np.concatenate([[0, 0], np.full(k, l2)])
        return row[0] - (pen * at**2).sum() / 2, grad - pen * at, hess - np.diag(pen)

    at = np.concatenate([[-1.0, 1.0], np.zeros(k)])
    value, grad, hess = sums(at)
    move, size, done = None, 1.0, 1
    while np.abs(grad).max() >= tol and done < rounds:
        if move is None:
            move, size = np.linalg.solve(1e-12 * np.eye(k + 2) - hess, grad), 1.0
        new = at + size * move
        if new[0] < new[1]:
            found, done = sums(new), done + 1
            if found[0] >= value - 1e-13 * (1 + abs(value)):
                at, (value, grad, hess), move = new, found, None
        size /= 2
        if size < 1e-10:
            break
    d.unpersist()
    if np.abs(grad).max() >= tol:
        warnings.warn(f"ordered_logit stopped after {done} rounds at a gradient of {np.abs(grad).max():.1e}", stacklevel=2)
    return np.concatenate([at[2:], at[:2]])


def ensemble(parts: list[tuple[float, list]]) -> list:
    """Weighted class probabilities, weights of the models that are there renormalised."""
    total = sum(w for w, p in parts if p is not None)
    return [sum(w / total * p[k] for w, p in parts if p is not None) for k in range(3)]


def combinatorial_ic(df: DataFrame, order: str, x: str, y: str, blocks: int, held: int) -> DataFrame:
    """Mean correlation over all ways to hold out ``held`` of ``blocks`` contiguous blocks.

    Blocks' moments are summed once; a combination is a sum of its blocks.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    span = d.agg(F.min(order).alias("a"), F.max(order).alias("b"))
    at = F.least(F.floor(F.datediff(F.col(order), F.col("a")) * blocks / F.greatest(F.datediff("b", "a"), F.lit(1))), F.lit(blocks - 1)).cast("int")
    m = d.join(F.broadcast(span)).groupBy(at.alias("block")).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(y) * F.col(y)).alias("syy"))
    combos = [F.struct(F.lit(k).alias("combo"), F.array(*[F.lit(i) for i in c]).alias("has")) for k, c in enumerate(itertools.combinations(range(blocks), held))]
    j = m.select("*", F.explode(F.array(*combos)).alias("c")).where(F.array_contains("c.has", F.col("block")))
    g = j.groupBy(F.col("c.combo").alias("combo")).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy")])
    cov, vx, vy = (F.col(f"s{a}{b}") * F.col("n") - F.col(f"s{a}") * F.col(f"s{b}") for a, b in (("x", "y"), ("x", "x"), ("y", "y")))
    return g.select("combo", "n", (cov / F.sqrt(vx * vy)).alias("ic"))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurt: float, trials: int, spread: float) -> float:
    """Chance that a Sharpe ratio beats the best of ``trials`` without skill."""
    from .optimize import normal_cdf

    euler = 0.5772156649015329
    quantile = lambda p: _normal_quantile(p)
    best = spread * ((1 - euler) * quantile(1 - 1 / trials) + euler * quantile(1 - 1 / (trials * math.e))) if trials > 1 else 0.0
    return normal_cdf((sharpe - best) * math.sqrt(n - 1) / math.sqrt(max(1e-12, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2)))


def _normal_quantile(p: float) -> float:
    from .optimize import normal_cdf

    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def fast_ica(cov: np.ndarray, sample: np.ndarray, k: int, seed: int = 0, rounds: int = 200) -> np.ndarray:
    """Unmixing rows of a bounded sample by the tanh fixed point."""
    values, vectors = np.linalg.eigh(cov)
    white = (vectors[:, -k:] / np.sqrt(values[-k:])).T
    z = white @ (sample - sample.mean(axis=0)).T
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, k)))[0]
    for _ in range(rounds):
        g = np.tanh(w @ z)
        new = g @ z.T / z.shape[1] - np.diag((1 - g**2).mean(axis=1)) @ w
        u, _, v = np.linalg.svd(new)
        new, w0 = u @ v, w
        w = new
        if np.abs(np.abs(np.diag(w @ w0.T)) - 1).max() < 1e-8:
            break
    return w @ white


def walk_forward_logit(df: DataFrame, order: str, y: str, xs: list[str], first: int, embargo: int, step: int = 26, l2: float = 2.0) -> DataFrame:
    """Expanding-window probabilities: folds fan out, each fits on rows at least ``embargo`` before it."""
    d = df.select(order, y, *xs)
    n = d.count()
    folds = [F.struct(F.lit(k).alias("_fold"), F.lit(a).alias("_first"), F.lit(min(n, a + step)).alias("_last")) for k, a in enumerate(range(first, n, step))]
    from .relational import global_row_number

    rows = global_row_number(d, [F.col(order)], "_i").select("*", F.explode(F.array(*folds)).alias("_f")).where(F.col("_i") <= F.col("_f._last"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a = int(pdf["_first"].iloc[0])
        pdf = pdf.sort_values("_i")
        known = pdf[(pdf["_i"] <= a - embargo)].dropna()
        test = pdf[pdf["_i"] > a].dropna(subset=xs)
        x, t = known[xs].to_numpy(float), known[y].to_numpy(float)
        if len(known) < 10 or len(set(t)) < 2:
            return test.assign(p=np.nan)[[order, y, "p"]]
        m, s = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        u, b = np.column_stack([np.ones(len(x)), (x - m) / s]), np.zeros(len(xs) + 1)
        pen = np.diag([0.0] + [l2] * len(xs))
        for _ in range(30):
            p = 1 / (1 + np.exp(-u @ b))
            move = np.linalg.solve(u.T @ (u * (p * (1 - p))[:, None]) + pen + 1e-9 * np.eye(len(b)), u.T @ (t - p) - pen @ b)
            b += move
            if np.abs(move).max() < 1e-8:
                break
        v = np.column_stack([np.ones(len(test)), (test[xs].to_numpy(float) - m) / s])
        return test.assign(p=1 / (1 + np.exp(-v @ b)))[[order, y, "p"]]

    schema = d.select(order, y).schema.add("p", "double")
    return rows.select("*", "_f._fold", "_f._first").drop("_f").groupBy("_fold").applyInPandas(fit, schema)
