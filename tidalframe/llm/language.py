"""Language identification by rank-order profiles.

A profile is a language's ``size`` most frequent character n-grams (1 to 3, of
lower-cased words with word ends), in order. Counts are summed over every
learning document: tasks count in a bounded table, the partial counts are
summed by language and n-gram, and only the finished profiles (languages x
``size`` rows) reach the driver. A document's own most frequent n-grams are
compared with each profile by out-of-place distance: how far each n-gram
stands from its place there, ``size`` where it is missing.

Ties are broken by n-gram, between languages by name. An n-gram is its code
points packed in 64 bits, so no two share a code.

Defined results: null text or text without a letter is ``und`` with score 0;
with no profile at all, everything is ``und``; documents of null language are
not learnt from; repeated rows count twice in profiles and are scored alike;
further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"


_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once a process."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_codes(text: str | None) -> np.ndarray:
    """The n-grams of a text, packed: letters, and pairs and triples with word ends as a blank.

    A pair has a letter, a triple one in its middle, so words don't run together.
    """
    c = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = letters()[c]
    c[~letter] = 32
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and their numbers."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, in order; of equal counts the smaller code."""
    if len(n) > size:
        top = n >= np.partition(n, len(n) - size)[len(n) - size]
        codes, n = codes[top], n[top]
    return codes[np.lexsort((codes, -n))[:size]]


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = 400) -> DataFrame:
    """``lang, code, rank`` (from 0) of every language's profile."""
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, rows = {}, {}, 0

        def reduce() -> None:
            for lang, parts in held.items():
                codes, n = counted(np.concatenate(parts))
                before = sums.get(lang)
                if before is not None:
                    both = np.concatenate([before[0], codes])
                    codes, at = np.unique(both, return_inverse=True)
                    n = np.bincount(at, np.concatenate([before[1], n])).astype(np.int64)
                sums[lang] = (codes, n)
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (codes, n) in sums.items():
                yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])
            sums.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(gram_codes(text))
                rows += len(held[lang][-1])
                if rows > 1_000_000:
                    reduce()
                    rows = 0
                    if sum(len(c) for c, _ in sums.values()) > 1_000_000:
                        yield from out()
        reduce()
        yield from out()

    sums = known.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    # A limit on the window's own number is taken in each task before the rows of a language meet.
    best = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return best.select("lang", "code", (F.col("rank") - 1).alias("rank"))


class Model:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.langs = size, sorted({r[0] for r in rows})
        self.codes = np.unique(np.asarray([r[1] for r in rows], np.int64))
        self.place = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        lang = {x: k for k, x in enumerate(self.langs)}
        for x, code, rank in rows:
            self.place[np.searchsorted(self.codes, code), lang[x]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and how near: 1 is an equal profile, 0 nothing shared."""
        codes, n = counted(gram_codes(text))
        if len(codes) == 0 or not self.langs:
            return UNKNOWN, 0.0
        mine = ranked(codes, n, self.size)
        at = np.searchsorted(self.codes, mine)
        at = np.where((at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == mine), at, len(self.codes))
        place = self.place[at]
        away = np.where(place < 0, self.size, np.abs(place - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.size * len(mine)))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = 400) -> Model:
    """Profiles of all ``docs``; the driver gets languages x ``size`` rows."""
    return Model([tuple(r) for r in profiles(docs, lang_col, text_col, size).collect()], size)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    taken = {c.lower() for c in docs.columns} & {lang_out.lower(), score_out.lower()}
    if taken:
        raise ValueError(f"the table has columns {sorted(taken)}: give other names")
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = held.value.predict
        for b in batches:
            out = [predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=[*b.schema.names, lang_out, score_out])

    return docs.mapInArrow(run, schema)
