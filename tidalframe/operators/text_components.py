"""TF-IDF of texts and its principal components by a randomised, distributed decomposition.

Rows stay sparse: a pass sends ``a (a' Q)`` of its rows, summed over a task, for
a thin matrix Q, so a task's message has (terms x components) numbers and the
square of the vocabulary is never formed. The driver orthogonalises Q.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import SPREAD


def terms_of(text: str, stop: tuple[str, ...]) -> Column:
    """Words of two or more word characters, lower-cased, without stop words, and pairs of those left that follow one another."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(\w\w+)")), lambda w: ~w.isin(*stop)) if stop else F.regexp_extract_all(F.lower(text), F.lit(r"(\w\w+)"))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.filter(pairs, lambda p: p.contains(" ")))


def tf_idf(df: DataFrame, keys: list[str], text: str, *, features: int = 200, stop: tuple[str, ...] = ()) -> DataFrame:
    """``keys, term, place, weight``: rows of unit length over the ``features`` most frequent terms (ties: the first), weight tf (ln((1+n)/(1+df)) + 1).

    Null texts have no terms; ``n`` counts texts that are not null.
    """
    texts = df.where(F.col(text).isNotNull())
    # Texts are dealt by key once; their terms, many times as large, are then counted where they are.
    each = texts.select(*keys, text).repartition(*keys).select(*keys, F.explode(terms_of(text, stop)).alias("term"))
    n = texts.agg(F.count("*").alias("_n"))
    top = each.groupBy(*keys, "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum("tf").alias("_all"), F.count("*").alias("_df")).orderBy(F.desc("_all"), "term").limit(features)
    # At most `features` rows: numbered and broadcast. Only their terms are counted again by text.
    vocabulary = top.agg(F.array_sort(F.collect_list(F.struct("term", "_df"))).alias("_v")).select(F.posexplode("_v").alias("place", "_t")).select("place", "_t.term", "_t._df")
    tf = each.join(F.broadcast(vocabulary), "term").groupBy(*keys, "term", "place", "_df").agg(F.count("*").alias("tf"))
    weighted = tf.join(F.broadcast(n)).withColumn("_w", F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1))
    length = F.sqrt(F.sum(F.col("_w") ** 2).over(Window.partitionBy(*keys)))
    return weighted.select(*keys, "term", "place", (F.col("_w") / length).alias("weight"))


def sparse_rows(weights: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, places, weights``: a row a text."""
    pairs = F.array_sort(F.collect_list(F.struct("place", "weight")))
    return weights.groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.col("_p.place").alias("places"), F.col("_p.weight").alias("weights"))


def _products(rows: DataFrame, q: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, their sum, and the sum of ``a (a' q)``."""
    dim, k = q.shape
    size = 1 + dim + dim * k

    def flat(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            places, values = (b.column(c) for c in (0, 1))
            ends = places.offsets.to_numpy()
            at, w = places.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64), values.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            inner = np.zeros((b.num_rows, k))
            np.add.at(inner, row, w[:, None] * q[at])
            total[0] += b.num_rows
            total[1 : 1 + dim] += np.bincount(at, w, dim)
            outer = np.zeros((dim, k))
            np.add.at(outer, at, w[:, None] * inner[row])
            total[1 + dim :] += outer.ravel()
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % SPREAD], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["place", "total"])

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((b.column(1).flatten().to_numpy().reshape(-1, size).sum(0) for b in batches if b.num_rows), np.zeros(size))
        yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], ["total"])

    parts = rows.select("places", "weights").mapInArrow(flat, "place int, total array<double>").repartition(SPREAD, "place").mapInArrow(added, "total array<double>")
    total = np.sum(np.array(parts.toArrow().column(0).to_pylist(), float).reshape(-1, size), 0)
    return round(total[0]), total[1 : 1 + dim], total[1 + dim :].reshape(dim, k)


def components(rows: DataFrame, dim: int, k: int, *, more: int = 10, passes: int = 6, seed: int = 0) -> dict:
    """Mean, the first ``k`` principal directions and their sample variances of sparse rows: one distributed pass for each of ``passes`` products.

    Directions are signed so that their largest element (in size) is positive.
    """
    wide = min(dim, k + more)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, wide)))[0]
    for step in range(passes):
        n, total, outer = _products(rows, q)
        mean = total / max(n, 1)
        cq = (outer - n * np.outer(mean, mean @ q)) / max(n - 1, 1)
        if step == passes - 1:
            break
        q = np.linalg.qr(cq)[0]
    values, turn = np.linalg.eigh((q.T @ cq + cq.T @ q) / 2)
    order = np.argsort(-values)[:k]
    load = q @ turn[:, order]
    load = load * np.where(load[np.abs(load).argmax(0), np.arange(load.shape[1])] < 0, -1.0, 1.0)
    return {"mean": mean, "loadings": load, "values": values[order], "n": n}


def scores(rows: DataFrame, model: dict, out: str = "scores") -> DataFrame:
    """Each row's coordinates along the components."""
    load, base = model["loadings"], model["mean"] @ model["loadings"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, values = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            ends = places.offsets.to_numpy()
            at, w = places.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64), values.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            found = np.tile(-base, (b.num_rows, 1))
            np.add.at(found, np.repeat(np.arange(b.num_rows), np.diff(ends)), w[:, None] * load[at])
            yield pa.record_batch([*b.columns[:-2], pa.array(list(found), pa.list_(pa.float64()))], [*keys, out])

    keys = [c for c in rows.columns if c not in ("places", "weights")]
    schema = rows.select(*keys).schema.add(out, T.ArrayType(T.DoubleType()))
    return rows.select(*keys, "places", "weights").mapInArrow(run, schema)
