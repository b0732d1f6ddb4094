"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (3 to 5, with word
ends) and of the word itself, all hashed to a fixed number of rows. A passage
is the mean of its words; a linear softmax over it gives the two classes.
Vectors and softmax are trained jointly, in numpy, on a bounded sample of
labelled documents. A spelling that was never seen shares n-grams with those
that were.

A document is judged by its most toxic passage: overlapping passages of
``passage`` words cover the whole text, so a few words in a long document are
not averaged away. Training does the same: the gradient flows through the
passage that decides.

Since average and softmax are linear in the word vectors, a fitted model is
one number a word, computed once for each distinct word of a task.

Defined results: null and empty texts have the score of the bias alone; with
no labelled rows or only one class among them, every score is that class's
share (0 with no rows); repeated rows score alike; further columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix
from .labelled import labelled_sample

_WORDS = re.compile(r"[^\W_]+").findall
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Characters of texts (one text at least) that are split into words at a time.
SLICE = 1 << 19


def grams_of(words: list[str], buckets: int, least: int = 3, most: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each word itself and its character n-grams, and how many each word has.

    All words at once: they lie in one array of code points, and an n-gram is
    the run of ``n`` points that stays within its word.
    """
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), length)
    ends = np.cumsum(length)
    left = ends[of] - np.arange(len(points))
    h, ids, hashes = np.zeros(len(points), np.uint64), [], []
    for n in range(1, most + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        h = mix(h[:m] + points[n - 1 :] * _SPREAD)
        if n >= least:
            at = np.flatnonzero(left[:m] >= n)
            ids.append(of[at]), hashes.append(h[at])
    whole = np.add.reduceat(mix(points * _SPREAD + (np.arange(len(points)) - (ends - length)[of]).astype(np.uint64)), ends - length)
    ids.append(np.arange(len(words))), hashes.append(mix(whole))
    of, hashes = np.concatenate(ids), np.concatenate(hashes)
    order = np.argsort(of, kind="stable")
    return (hashes[order] % np.uint64(buckets)).astype(np.int64), np.bincount(of, minlength=len(words))


def passages_of(n: int, passage: int) -> np.ndarray:
    """Word ranges of ``passage`` words, each half over the last; the end is covered too."""
    if n <= passage:
        return np.asarray([[0, n]])
    starts = np.append(np.arange(0, n - passage, max(1, passage // 2)), n - passage)
    return np.stack([starts, starts + passage], axis=1)


def means(values: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (total[ranges[:, 1]] - total[ranges[:, 0]]) / (ranges[:, 1] - ranges[:, 0])


def first_only(values: np.ndarray, passage: int) -> np.ndarray:
    """Zeros for words that occurred within the last ``passage`` words.

    A bag holds a word once; its size stays the passage's.
    """
    order = np.argsort(values, kind="stable")
    again = (values[order[1:]] == values[order[:-1]]) & (order[1:] - order[:-1] < passage)
    values[order[1:][again]] = 0.0
    return values


class Model:
    """``weights``: one number a hashed n-gram, the two-class softmax's difference."""

    def __init__(self, weights: np.ndarray | None, bias: float, passage: int, constant: float | None = None):
        self.weights, self.bias, self.passage, self.constant = weights, bias, passage, constant
        self.slope, self.shift, self.known = 1.0, 0.0, {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def margins(self, texts: list[str | None]) -> np.ndarray:
        out, lo = np.zeros(len(texts)), 0
        while lo < len(texts):  # the words of all texts at once are many times as large as the texts
            hi, size = lo + 1, len(texts[lo] or "")
            while hi < len(texts) and (size := size + len(texts[hi] or "")) <= SLICE:
                hi += 1
            out[lo:hi] = self._margins(texts[lo:hi])
            lo = hi
        return out + self.bias

    def _margins(self, texts: list[str | None]) -> np.ndarray:
        split = [_WORDS((t or "").lower()) for t in texts]
        if len(self.known) > 200_000:
            self.known.clear()
        known = self.known
        new = sorted({w for words in split for w in words if w not in known})
        for k in range(0, len(new), 4000):
            part = new[k : k + 4000]
            rows, size = grams_of(part, len(self.weights))
            known.update(zip(part, (np.add.reduceat(self.weights[rows], np.cumsum(size) - size) / size).tolist(), strict=True))
        out = np.zeros(len(texts))
        for k, words in enumerate(split):
            if words:
                out[k] = means(first_only(np.fromiter(map(known.__getitem__, words), np.float64, len(words)), self.passage), passages_of(len(words), self.passage)).max()
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -50, 50)))


def fit(
    texts: list[str], labels: list[int], *, dim: int = 8, buckets: int = 1 << 17, passage: int = 16, rounds: int = 12, batch: int = 64, rate: float = 0.3, hard: int = 2, warm: int = 2, prior: float = 0.5, seed: int = 7
) -> Model:
    """Adagrad on embeddings and softmax together.

    Each round first finds the passages that decide: the most toxic one of a
    toxic document, the ``hard`` most toxic ones of a clean document. Before
    the model knows anything, words are judged by their class log-count ratio
    (those of one document only not at all). Every
    fifth document is set aside; a logistic curve over its margin, for classes
    in the ratio ``prior``, makes the score.
    """
    if len(set(labels)) < 2:
        return Model(None, 0.0, passage, float(labels[0]) if labels else 0.0)
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(labels), bool)
    for k in (0, 1):
        aside[np.flatnonzero(np.asarray(labels) == k)[::5]] = True
    if (~aside & (np.asarray(labels) == 1)).any() and (~aside & (np.asarray(labels) == 0)).any():
        held = [(t, k) for t, k, a in zip(texts, labels, aside, strict=True) if a]
        texts, labels = [t for t, a in zip(texts, aside, strict=True) if not a], [k for k, a in zip(labels, aside, strict=True) if not a]
    else:
        held = []
    vocabulary: dict[str, int] = {}
    docs = [np.asarray([vocabulary.setdefault(w, len(vocabulary)) for w in _WORDS(t.lower())], np.int64) for t in texts]
    ranges = [passages_of(len(d), passage) for d in docs]
    y = np.asarray(labels, np.float64)
    # Some thousand words at a time: the arrays of all at once are most of what a fit holds.
    known, parts = list(vocabulary), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    parts += [grams_of(known[k : k + 4000], buckets) for k in range(0, len(known), 4000)]
    gram, size = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    start = np.cumsum(size) - size
    emb, soft, bias = rng.standard_normal((buckets, dim)) * 0.05, rng.standard_normal((dim, 2)) * 0.5, np.zeros(2)
    emb_sum, soft_sum, bias_sum = np.full(buckets, 1e-6), np.full((dim, 2), 1e-6), np.full(2, 1e-6)
    share = np.where(y == 1, 0.5 * len(y) / y.sum(), 0.5 * len(y) / (len(y) - y.sum()) / hard)
    # A small sample gets more rounds, for about as many updates.
    rounds = max(rounds, -(-800 * batch // max(1, len(docs) * 2))) if vocabulary else 0
    in_docs = np.zeros((2, len(vocabulary)))
    for d, k in zip(docs, labels, strict=True):
        in_docs[k, np.unique(d)] += 1
    total, each_class = in_docs.sum(axis=0), np.bincount(labels, minlength=2)
    smooth = 2 * each_class[:, None] / len(docs)
    ratio = np.log((in_docs[1] + smooth[1]) / each_class[1]) - np.log((in_docs[0] + smooth[0]) / each_class[0])
    ratio[total < 2] = 0
    for k in range(rounds):
        value = ratio if k < warm else np.add.reduceat((emb @ (soft[:, 1] - soft[:, 0]))[gram], start) / size
        picks = []
        for k, (d, r) in enumerate(zip(docs, ranges, strict=True)):
            if len(d):
                top = np.argsort(-means(first_only(value[d], passage), r), kind="stable")[: 1 if y[k] else hard]
                picks += [(k, *r[t]) for t in top]
        for at in np.array_split(rng.permutation(len(picks)), max(1, len(picks) // batch)):
            mine = [picks[k] for k in at]
            n = np.asarray([b - a for _, a, b in mine])
            bags = [np.unique(docs[k][a:b]) for k, a, b in mine]
            words, size_of = np.concatenate(bags), np.asarray([len(x) for x in bags])
            label, weight = y[[k for k, _, _ in mine]], share[[k for k, _, _ in mine]]
            g = size[words]
            rows = gram[np.repeat(start[words] - (np.cumsum(g) - g), g) + np.arange(g.sum())]
            each = np.add.reduceat(emb[rows], np.cumsum(g) - g) / g[:, None]
            mean = np.add.reduceat(each, np.cumsum(size_of) - size_of) / n[:, None]
            z = mean @ soft + bias
            p = 1 / (1 + np.exp(-np.clip(z[:, 1] - z[:, 0], -30, 30)))
            d1 = weight * (p - label) / len(mine)
            dz = np.stack([-d1, d1], axis=1)
            back = np.repeat(np.repeat((dz @ soft.T) / n[:, None], size_of, axis=0) / g[:, None], g, axis=0)
            d_soft, d_bias = mean.T @ dz, dz.sum(axis=0)
            order = np.argsort(rows, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) != 0]))
            hit, d_emb = rows[order][first], np.add.reduceat(back[order], first)
            emb_sum[hit] += (d_emb * d_emb).mean(axis=1)
            emb[hit] -= rate * d_emb / np.sqrt(emb_sum[hit])[:, None]
            soft_sum += d_soft * d_soft
            soft -= 0.1 * rate * d_soft / np.sqrt(soft_sum)
            bias_sum += d_bias * d_bias
            bias -= 0.1 * rate * d_bias / np.sqrt(bias_sum)
    model = Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), passage)
    if held:
        k = np.asarray([k for _, k in held])
        model.slope, model.shift = curve(model.margins([t for t, _ in held]), k, np.where(k == 1, prior, 1 - prior) / np.where(k == 1, (k == 1).mean(), (k == 0).mean()))
        model.known = {}
    return model


def curve(z: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins, by Newton's method.

    Targets are smoothed by one count, so perfect separation stays finite.
    """
    z = np.clip(z, -20, 20)
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    t = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(slope * z + shift, -50, 50)))
        g = np.asarray([(weight * (s - t) * z).sum() + 1e-2 * (slope - 1), (weight * (s - t)).sum()])
        r = weight * s * (1 - s) + 1e-9
        h = np.asarray([[(r * z * z).sum() + 1e-2, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-4]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = slope - float(move[0]), shift - float(move[1])
    return max(slope, 1e-3), shift


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", *, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500, **params) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, whole texts.

    The ratio of the classes is that of all labels.
    """
    texts, known, share = labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, per_class=per_class)
    return fit(texts, known, prior=min(max(share, 0.01), 0.99), **params)


def score(docs: DataFrame, model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score 0..1 of every whole text (also other models with ``scores(texts)``)."""
    if out_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {out_col}: give another out_col")
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = held.value.scores
        for b in batches:
            out = scores(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def crc_mod(id_col: str, n: int):
    """crc32 of the identifier as text, modulo ``n``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
