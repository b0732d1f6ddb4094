"""Document quality by Naive Bayes support vectors.

Features say whether an n-gram (1 or 2 tokens, hashed) occurs in the whole
text. Tokens are words, signs, and the words' shapes. Each indicator is scaled
by the class log-count ratio of its feature, rows are scaled to length one,
and a linear hinge-loss model is fit by dual coordinate descent. Its margin,
through a logistic curve fitted to the training margins, is the score.

Fitted on a bounded sample of labelled documents (``per_class``); scored on
every whole text. Defined results: null and empty texts have no feature and
the score of the bias alone; without two classes among the labels every score
is the one class's share (0 with no rows); repeated rows score alike; further
columns stay.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .labelled import labelled_sample
from .toxicity import curve

#: The pair of a token and itself is one feature, whatever the token.
_AGAIN = np.uint64(0xA6A1)
_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\s\w]+|_+|\n+").findall


def shape_of(token: str) -> str:
    """A letter case, a number, or the signs themselves."""
    if token.isalpha():
        return "w" if token.islower() else "W" if token.isupper() else "Ww"
    if token.isnumeric():
        return "9"
    return token[:3]


class Features:
    """Hashed indicators of a text; token hashes are remembered, boundedly."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def __getstate__(self):
        return {"buckets": self.buckets, "known": {}}

    def _token(self, t: str) -> tuple[int, int]:
        if len(self.known) > 500_000:
            self.known.clear()
        out = self.known[t] = (xxhash.xxh3_64_intdigest(t.lower()), xxhash.xxh3_64_intdigest("shape " + shape_of(t)))
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = _TOKENS(text or "")
        if not tokens:
            return np.zeros(0, np.int64)
        known, make = self.known, self._token
        both = np.asarray([known.get(t) or make(t) for t in tokens], np.uint64)
        word, shape = both[:, 0], both[:, 1]
        k = np.uint64(0x9E3779B97F4A7C15)
        pairs = [(x[:-1] * k) ^ (x[1:] + k) for x in (word, shape)]
        pairs[0][word[:-1] == word[1:]] = _AGAIN
        h = np.concatenate([word, shape, *pairs])
        return np.unique((h ^ (h >> np.uint64(29))) % np.uint64(self.buckets)).astype(np.int64)


class Model:
    def __init__(self, features: Features, weights: np.ndarray, bias: float, slope: float, shift: float, scale: np.ndarray, constant: float | None = None):
        self.features, self.weights, self.bias, self.slope, self.shift, self.scale, self.constant = features, weights, bias, slope, shift, scale, constant

    def margin(self, text: str | None) -> float:
        at = self.features(text)
        if len(at) == 0:
            return self.bias
        x = self.scale[at]
        return float(x @ self.weights[at]) / max(float(np.sqrt(x @ x)), 1e-12) + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = np.fromiter(map(self.margin, texts), np.float64, len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -50, 50)))


def _descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, buckets: int, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss linear SVM, bias as a further feature."""
    w, b, alpha, rng = np.zeros(buckets), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.asarray([float(v @ v) for v in values]) + 1.0
    limit = cost * np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, b


def fit(texts: list[str], labels: list[int], *, buckets: int = 1 << 18, smooth: float = 1.0, cost: float = 1.0, rounds: int = 30, seed: int = 7) -> Model:
    features = Features(buckets)
    if len(set(labels)) < 2:
        return Model(features, np.zeros(0), 0.0, 1.0, 0.0, np.zeros(0), float(labels[0]) if labels else 0.0)
    rows = [features(t) for t in texts]
    y = np.where(np.asarray(labels) == 1, 1.0, -1.0)
    p, q = np.full(buckets, smooth), np.full(buckets, smooth)
    for r, k in zip(rows, y, strict=True):
        (p if k > 0 else q)[r] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    values = [ratio[r] / max(float(np.sqrt(ratio[r] @ ratio[r])), 1e-12) for r in rows]
    w, b = _descend(rows, values, y, buckets, cost, rounds, seed)
    z = np.asarray([w[r] @ v + b for r, v in zip(rows, values, strict=True)])
    slope, shift = curve(z, (y > 0).astype(int), np.ones(len(y)))
    return Model(features, w.astype(np.float32), b, slope, shift, ratio.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", *, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500, **params) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, whole texts."""
    texts, known, _ = labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, per_class=per_class)
    return fit(texts, known, **params)
