"""Benchmark passages in documents by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` words (an item with fewer
is one window). A document is contaminated where it contains a window.

1. Documents look up their shingles of ``shingle`` words in a bit filter of
   fixed size over the windows' shingles. The runs of words that found ones
   cover are written as passages: no shingle of a window, so no window, lies
   outside of one. This is the only pass over whole texts.
2. In the passages the windows' shingles are counted, which counts them over
   all documents, and ordered by rarity. A document contains a window only if
   it contains every shingle of it, so for full containment the necessary
   prefix is one token: the window's rarest shingle, with its offset in it.
3. Passages look up their shingles in a bit filter over the prefix tokens and
   send on the hits only: token, position, the words around. These join the
   windows by token.
4. The offset bounds the place (a window must start and end inside the
   passage), and the words around are compared with the window itself.

What is broadcast are the bit filters, whose size is fixed; items and windows
are joined, so a benchmark may be of any size.

Defined results: null text or item text has no words; an item without words
has no window; repeated items count once by ``item_id`` but their windows
unite; a null ``item_id`` is ignored; repeated rows are marked alike; empty
tables leave every document clean. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BitFilter, WordHash, bytes_of, cut, fresh, shingles, signed, words_of


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """``item, window, hashes``: each window's text and its shingles' hashes in order."""
    narrow = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null")

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for b in batches:
            names, texts, hashes = [], [], []
            for item, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), strict=True):
                words = words_of(text)
                for k in range(max(1, len(words) - window + 1) if words else 0):
                    part = words[k : k + window]
                    names.append(item), texts.append(b" ".join(part)), hashes.append(shingles(hashed(part), shingle).view(np.int64))
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], ["item", "window", "hashes"])

    return narrow.mapInArrow(split, "item string, window binary, hashes array<long>")


def _blocks(texts: list[bytes], most: int = 16_384) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The words of some texts at a time, in one list, and where each text ends in it: short texts share numpy's calls."""
    words, ends = [], []
    for text in texts:
        words += words_of(text)
        ends.append(len(words))
        if len(words) >= most:
            yield words, np.array(ends)
            words, ends = [], []
    if ends:
        yield words, np.array(ends)


def _hits(words: list[bytes], ends: np.ndarray, sizes: list[int], hashed: WordHash, bits: BitFilter) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length that the windows have, the shingles in the filter: length, and for each its text, place and hash."""
    hashes = hashed(words)
    for n in sizes:
        if len(hashes) >= n:
            h = shingles(hashes, n)
            at = np.flatnonzero(bits.has(h))
            text = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[text]
            yield n, text[inside], at[inside], h[at[inside]]


def _shingle_sizes(windows: DataFrame, shingle: int) -> list[int]:
    size = F.least(F.size(F.split(F.col("window").cast("string"), " ")), F.lit(shingle))
    return sorted(r[0] for r in windows.select(size.alias("s")).distinct().collect())


def _passages(narrow: DataFrame, sizes: list[int], held) -> DataFrame:
    """``id, n_words, parts``: of each text the runs of words that shingles in the filter cover, with their first word's place."""
    part = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.BinaryType())])
    schema = T.StructType([narrow.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("parts", T.ArrayType(part))])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, bits = WordHash(), held.value
        for b in batches:
            n_words, n_parts, firsts, runs = [], [], [], []
            for words, ends in _blocks(bytes_of(b.column(1))):
                n_words.append(np.diff(ends, prepend=0))
                # A place is shifted by its text's number, so that runs of neighbouring texts never touch.
                step, gap = np.zeros(len(words) + len(ends) + 1, np.int32), np.arange(len(ends))
                for n, text, at, _ in _hits(words, ends, sizes, hashed, bits):
                    step[at + text] += 1
                    step[at + text + n] -= 1
                lo, hi = np.flatnonzero(np.diff(np.cumsum(step) > 0, prepend=False)).reshape(-1, 2).T
                text = np.searchsorted(ends + gap + 1, lo, side="right")
                n_parts.append(np.bincount(text, minlength=len(ends)))
                firsts.append(lo - (ends - n_words[-1] + gap)[text])
                runs += [b" ".join(words[i:j]) for i, j in zip((lo - text).tolist(), (hi - text).tolist(), strict=True)]
            if n_words:
                first, offsets = np.concatenate(firsts), np.concatenate([[0], *n_parts]).cumsum()
                parts = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(runs, pa.binary())], ["first", "words"])
                yield pa.record_batch([b.column(0), pa.array(np.concatenate(n_words), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)], ["id", "n_words", "parts"])

    return narrow.mapInArrow(find, schema)


def _shingle_counts(passages: DataFrame, sizes: list[int], held) -> DataFrame:
    """``h, n``: how often each of the windows' shingles occurs in all passages."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, bits, kept, rows = WordHash(), held.value, [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.record_batch([signed(h), pa.array(n.astype(np.int64))], ["h", "n"])

        for b in batches:
            for words, ends in _blocks(bytes_of(b.column(0))):
                for *_, h in _hits(words, ends, sizes, hashed, bits):
                    kept.append(h)
                    rows += len(h)
            if rows > 1_000_000:
                yield out()
                kept, rows = [], 0
        if rows:
            yield out()

    return passages.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *,
    window: int = 10, shingle: int = 5, log2_bits: int | None = None,
) -> DataFrame:
    """One row per input row: ``id, n_words, spans, items``.

    ``spans`` are the word ranges [start, end) that windows cover, merged;
    ``items`` the sorted ids (strings) of the items with a window here.
    """
    spark = docs.sparkSession
    windows = cut(item_windows(items, item_col, item_text_col, window, shingle), "windows")
    sizes = _shingle_sizes(windows, shingle)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Many bits a key: what passes by chance would become a passage.
    tokens = spark.sparkContext.broadcast(BitFilter.of(windows.select(F.explode("hashes").alias("h")).distinct(), "h", log2_bits, per_key=256))
    looked = cut(_passages(narrow, sizes, tokens).withColumn("row", F.monotonically_increasing_id()), "passages")
    passages = looked.select("row", F.inline("parts"))
    counts = _shingle_counts(passages.select("words"), sizes, tokens)
    # The rarest shingle of a distinct window; ties go to the smaller hash, then the smaller offset.
    distinct = windows.groupBy("window").agg(F.first("hashes").alias("hashes"))
    placed = distinct.select("window", F.posexplode("hashes").alias("offset", "h")).join(counts, "h", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("best")
    prefix = cut(placed.groupBy("window").agg(rarest).select("window", F.col("best.h").alias("h"), F.col("best.offset").alias("offset"), F.col("best.n").alias("n")), "prefixes")
    held = spark.sparkContext.broadcast(BitFilter.of(prefix.where("n > 0"), "h", log2_bits))

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, bits, kept = WordHash(), held.value, []

        def out() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), types, strict=True)], ["row", "h", "at", "left", "around"])

        for b in batches:
            rows, firsts, done = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            for words, ends in _blocks(bytes_of(b.column(2))):
                begins = [0, *ends.tolist()]
                for n, run, at, h in _hits(words, ends, sizes, hashed, bits):
                    for k, i, x in zip(run.tolist(), at.tolist(), h.view(np.int64).tolist(), strict=True):
                        lo = max(begins[k], i - (window - n))
                        kept.append((rows[done + k], x, firsts[done + k] + i - begins[k], i - lo, b" ".join(words[lo : min(i + window, begins[k + 1])])))
                        if len(kept) > 20_000:
                            yield out()
                            kept.clear()
                done += len(ends)
        if kept:
            yield out()

    hits = passages.mapInArrow(look_up, "row long, h long, at int, left int, around binary")
    around, words = F.split(F.col("around").cast("string"), " "), F.split(F.col("window").cast("string"), " ")
    start = F.col("left") - F.col("offset")
    found = (
        hits.join(prefix, "h")
        .where((F.col("left") >= F.col("offset")) & (start + F.size(words) <= F.size(around)))
        .where(F.slice(around, F.when(start >= 0, start + 1).otherwise(1), F.size(words)) == words)
        .select("row", "window", (F.col("at") - F.col("offset")).alias("start"), (F.col("at") - F.col("offset") + F.size(words)).alias("end"))
    )
    found = cut(found, "found")
    # Ranges merged in order of their starts: each range either extends the last or opens the next.
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def merge(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(last["end"] >= x["start"], F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    spans = found.groupBy("row").agg(F.aggregate(F.array_sort(F.collect_set(F.struct("start", "end"))), empty, merge).alias("spans"))
    named = found.select("row", "window").distinct().join(windows.select("window", "item").distinct(), "window")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.expr("cast(array() as array<string>)")
    return (
        looked.select("row", "id", "n_words")
        .join(spans.join(named, "row"), "row", "left")
        .select("id", "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("items", none).alias("items"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without contaminated rows, columns unchanged.

    Rows are told apart by identifier and text.
    """
    key = fresh(docs, "_text_hash")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col)))
    both = keyed.select(F.struct(F.col(id_col).alias("id"), F.col(key).alias("h")).alias("pair"), F.col(text_col).alias("text"))
    bad = contamination(both, items, "pair", "text", **params).where(F.size("spans") > 0)
    bad = bad.select(F.col("id.id").alias("_bad_id"), F.col("id.h").alias("_bad_hash")).distinct()
    return keyed.join(bad, keyed[id_col].eqNullSafe(bad["_bad_id"]) & (keyed[key] == bad["_bad_hash"]), "left_anti").drop(key)
