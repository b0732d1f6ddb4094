"""Ranked lexical search: MaxScore over shards of the corpus.

One pass over the documents writes an index of shards to the shared folder: for
each run of documents their sizes and, for the terms that are asked for, posting
lists. Frequencies and totals are summed from the index. Then every shard is
searched for all queries of a block: terms whose upper bounds together stay
below the score of the query's last place are non-essential; only postings of
the other terms bring up candidates, and non-essential postings are probed, the
largest bound first, for candidates that can still qualify. A task keeps each
query's best rows from shard to shard and hands on ``k`` a query.

* Nothing about the corpus is collected but document frequencies of the asked
  terms and two totals. Queries are taken in blocks of ``block_bytes`` of text
  (by identifier hash), each with an index of its own terms; a block is what the
  tasks hold.
* A shard is closed at ``shard_bytes`` of text or ``shard_docs`` documents; a
  longer document is a shard of its own.
* Pruning is exact: a row is dropped only when its bound is below the last place.

Cases: null and empty texts have no terms, so they are not counted, found or
answered; equal rows of the corpus are ranked one by one; equal rows of the
queries count once; equal scores rank by identifier, null identifiers last; an
empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, cut, held_batches, words_of

_INDEX = "ids array<long>, sizes array<int>, terms array<int>, df array<int>, rows array<int>, tf array<int>"
#: Stands for a null identifier inside a task: behind all others.
_LAST = np.iinfo(np.int64).max


def _shards(docs: DataFrame, terms: dict[bytes, int], shard_bytes: int, shard_docs: int) -> DataFrame:
    """The index, from ``id, text``: a row a shard. Postings are ordered by term, then row."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, postings, read = [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal read
            p = np.array(postings, np.int32).reshape(-1, 3)
            p = p[np.argsort(p[:, 0], kind="stable")]
            at, df = np.unique(p[:, 0], return_counts=True)
            row = [pa.array([x], pa.list_(t)) for x, t in ((ids, pa.int64()), (sizes, pa.int32()), (at, pa.int32()), (df.astype(np.int32), pa.int32()), (p[:, 1], pa.int32()), (p[:, 2], pa.int32()))]
            ids.clear(), sizes.clear(), postings.clear()
            read = 0
            return pa.record_batch(row, ["ids", "sizes", "terms", "df", "rows", "tf"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), strict=True):
                words = words_of(text)
                if not words:
                    continue
                if ids and (read + len(text) > shard_bytes or len(ids) >= shard_docs):
                    yield out()
                postings.extend((terms[w], len(ids), n) for w, n in Counter(words).items() if w in terms)
                ids.append(name)
                sizes.append(len(words))
                read += len(text)
        if ids:
            yield out()

    return docs.mapInArrow(build, _INDEX)


class _Best:
    """The ``k`` best rows of one query so far."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a row must score to be worth a look."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


def max_score(lists: list[tuple[int, np.ndarray, np.ndarray]], least: int, scores: np.ndarray) -> np.ndarray:
    """Rows that score ``least`` or more, their scores left in ``scores`` (zeros at first).

    ``lists``: for each term its upper bound, its rows in order, and what it adds to each. All else in ``scores`` is left undefined.
    """
    lists = sorted(lists, key=lambda x: x[0])
    reach = np.cumsum([x[0] for x in lists])
    split = int(np.searchsorted(reach, least))  # the terms before it cannot bring a row to `least` together
    for _, rows, adds in lists[split:]:
        scores[rows] += adds
    found = np.flatnonzero(scores)
    for k in range(split - 1, -1, -1):
        found = found[scores[found] + reach[k] >= least]
        if not len(found):
            break
        _, rows, adds = lists[k]
        at = np.minimum(np.searchsorted(rows, found), len(rows) - 1)
        hit = rows[at] == found
        scores[found[hit]] += adds[at[hit]]
    return found[scores[found] >= least]


def _searched(index: DataFrame, asked: list[tuple[object, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``q, id, score``: each task's ``k`` best rows of each query. ``asked``: terms and how often each occurs in a query."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in asked]
        for b in batches:
            for shard in range(b.num_rows):
                ids, sizes, terms, df, rows, tf = (b.column(c)[shard].values for c in range(6))
                ids = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
                sizes, terms, df, rows, tf = (x.to_numpy().astype(np.int64) for x in (sizes, terms, df, rows, tf))
                if not len(terms):
                    continue
                m = 75 + (25 * sizes * n_docs) // n_terms
                part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[rows]) * np.repeat(weights[terms], df)
                starts = np.cumsum(df) - df
                bound = np.maximum.reduceat(part, starts)
                place = {t: j for j, t in enumerate(terms.tolist())}
                scores = np.zeros(len(ids), np.int64)
                for query, top in zip(asked, best, strict=True):
                    lists = []
                    for t, times in query[1]:
                        j = place.get(t)
                        if j is not None and bound[j]:
                            span = slice(starts[j], starts[j] + df[j])
                            lists.append((int(bound[j]) * times, rows[span], part[span] * times if times > 1 else part[span]))
                    if lists:
                        found = max_score(lists, top.least, scores)
                        if len(found):
                            top.add(scores[found], ids[found])
                        scores[:] = 0
        for q, top in enumerate(best):
            if len(top.id):
                yield pa.record_batch([pa.array(np.full(len(top.id), q, np.int32)), pa.array(top.id, mask=top.id == _LAST), pa.array(top.score)], ["q", "id", "score"])

    return index.mapInArrow(find, "q int, id long, score long")


def ranked_search(
    docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text",
    k: int = 20, shard_bytes: int = 8 << 20, shard_docs: int = 8192, block_bytes: int = 4 << 20,
) -> DataFrame:
    """``item, rank, id, score``: for each query its ``k`` documents of highest score above 0.

    Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. With N documents that have
    terms, L terms in all, df documents that hold a term, tf its occurrences in a document of n terms:
    ``floor(1000 ln((2N+2) / (2df+1))) * (10^9 tf // (1000 tf + 12 m))``, ``m = 75 + 25 n N // L``, summed over the
    query's terms with repeats; integers throughout but for the logarithm.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = cut(queries.select(F.col(item_col).alias("item"), F.col(query_col).alias("text")).where("text is not null").distinct(), "queries")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    found = []
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toArrow()
        counts = [(item, Counter(words_of(text))) for item, text in zip(mine["item"].to_pylist(), bytes_of(mine["text"].combine_chunks()), strict=True)]
        terms = {w: i for i, w in enumerate(sorted({w for _, c in counts for w in c}))}
        asked = [(item, [(terms[w], n) for w, n in c.items()]) for item, c in counts if c]
        if not asked:
            continue
        with held_batches(spark):
            index = cut(_shards(texts, terms, shard_bytes, shard_docs), "search-index")
        n_docs, n_terms = index.agg(F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()
        if not n_docs:
            continue
        df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).toArrow()
        weights = np.zeros(len(terms), np.int64)
        for t, f in zip(df["terms"].to_pylist(), df["df"].to_pylist(), strict=True):
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1)))
        with held_batches(spark):
            top = cut(_searched(index, asked, weights, n_docs, n_terms, k), "search-top")
        names = spark.createDataFrame([(q, a[0]) for q, a in enumerate(asked)], f"q int, item {items.schema['item'].dataType.simpleString()}")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.append(ranked.join(F.broadcast(names), "q").select("item", "rank", "id", "score"))
    if not found:
        return spark.createDataFrame([], f"item {items.schema['item'].dataType.simpleString()}, rank int, id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
