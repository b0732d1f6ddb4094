"""Repeated byte strings across all texts, by threshold-bounded interval expansion.

Every byte that a ``length``-byte string covers which also starts anywhere else
(in any text, or in the same one) is removed. Matches never cross texts.

1. Anchors. In a string of ``length`` bytes, the ``gram``-byte piece of least
   hash (the leftmost of equals) is its anchor. Equal strings have equal
   anchors at equal offsets, so only starts with equal anchors need comparing.
   Neighbouring starts with one anchor form a range: one row, not hundreds.
2. Ranges whose anchor occurs once are done: nothing repeats there. Ranges that
   are equal in every byte they cover count as one, with their number; if that
   is two or more, each start in them repeats.
3. What is left are ranges that share an anchor but differ somewhere: the
   borders of copies. Their bytes, once for each distinct range, are dealt to
   shards of bounded size. A shard sorts its suffixes by ``length`` bytes,
   takes the Burrows-Wheeler transform, and expands intervals breadth first:
   level by level, each interval is extended backward by each byte that
   precedes it, and an end that nothing has reached before has a common prefix
   of just that level. Expansion stops at ``length``. A border between
   neighbours that was never reached has a common prefix of ``length`` bytes or
   more: both neighbours repeat.
4. An anchor with more than ``shard_bytes`` of distinct ranges is not gathered:
   its starts are counted by a 128-bit hash of their whole strings.

Equality of ranges, and of strings in 4, is equality of their 128-bit XXH3 hash:
of n different ranges some two are taken for equal with a chance of about
n^2 / 2^129 (10^-15 for 10^12 of them), whatever their bytes have in common; it
is no hash against somebody who makes collisions on purpose. What is broadcast
are bit filters of bounded size.

Defined results: null text is empty; texts shorter than ``length`` lose
nothing; a repeated row is a copy like any other; an empty table gives an
empty result; a cut may leave bytes that are no UTF-8, so the kept text is
binary; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BitFilter, bytes_of, cut, mix, signed

_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


class Rolling:
    """64-bit hashes of all pieces of one size of a text, from prefix sums. They choose anchors and decide nothing."""

    _powers: list[np.ndarray] = []

    @classmethod
    def powers(cls, n: int) -> list[np.ndarray]:
        if not cls._powers or len(cls._powers[0]) < n:
            both = []
            for b in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(max(n, 1 << 16), np.uint64(b))
                p[0] = 1
                both.append(np.cumprod(p, dtype=np.uint64))
            cls._powers = both
        return cls._powers

    def __init__(self, data: np.ndarray):
        up, self.inverse = self.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def all_of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n] + np.uint64(length))


def digests(pieces: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each piece's 128-bit hash."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of the least, the leftmost of equals."""
    n = len(h)
    value = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    blocks = np.concatenate([value, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(back[:m], ahead[width - 1 : width - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def ranges_of(text: bytes, length: int, gram: int):
    """Ranges of starts of ``length``-byte strings with one anchor.

    Returns (first start, last start, anchor hash, two hashes of all bytes that
    the range's strings cover).
    """
    data = np.frombuffer(text, np.uint8)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3
    if len(data) < length:
        return none
    h = Rolling(data).all_of(gram)
    at = sliding_argmin(h, length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return first, last, h[at[first]], *digests(text[a : z + length] for a, z in zip(first.tolist(), last.tolist(), strict=True))


def sort_suffixes(symbols: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in order of their first ``length`` symbols, by prefix doubling.

    ``left``: symbols before the end of the suffix's own range. A suffix that
    ends earlier counts as distinct from all others.
    """
    n = len(symbols)
    width = min(7, length)
    key = np.zeros(n, np.int64)
    for k in range(min(width, n)):
        key[: n - k] |= symbols[k:].astype(np.int64) << (9 * (6 - k))
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]) & (left[order[1:]] >= width) & (left[order[:-1]] >= width)
    rank = np.empty(n, np.int64)
    head = np.concatenate([[True], ~same])
    place = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = place
    open_ = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    while width < length and len(open_):
        step = min(width, length - width)
        suffix = order[open_]
        nxt = rank[np.minimum(suffix + step, n - 1)]
        group = place[open_]
        by = np.argsort(group * n + nxt, kind="stable")
        suffix, nxt = suffix[by], nxt[by]
        order[open_] = suffix
        short = left[suffix] < width + step
        same = (group[1:] == group[:-1]) & (nxt[1:] == nxt[:-1]) & ~short[1:] & ~short[:-1]
        head = np.concatenate([[True], ~same])
        place[open_] = np.maximum.accumulate(np.where(head, open_, 0))
        rank[suffix] = place[open_]
        open_ = open_[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        width += step
    return order


def short_prefixes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether suffix ``k`` shares fewer than ``length`` symbols with the one before it.

    Interval expansion on the transform. Symbol 0 ends a range and is never
    extended, so no interval crosses ranges. Level ``l`` holds the intervals
    of strings of ``l`` symbols that ended a new border; an interval of one
    row is extended by its only symbol, larger ones by each distinct one.
    """
    n = len(symbols)
    bwt = symbols[order - 1].astype(np.int64)  # at 0: the last, which ends a range
    by = np.argsort(bwt, kind="stable")
    held = bwt[by] * (n + 1) + by  # (symbol, row), sorted: rank queries are searches here
    to = np.empty(n, np.int64)
    to[by] = np.arange(n)  # the row of the suffix that is one symbol longer
    reached = np.zeros(n + 1, bool)
    reached[[0, n]] = True
    lo, hi = np.asarray([0]), np.asarray([n])
    for _ in range(length):
        one = hi - lo == 1
        a = lo[one]
        a = a[bwt[a] > 0]
        starts, ends = [to[a]], [to[a] + 1]
        lo, hi = lo[~one], hi[~one]
        if len(lo):
            size = hi - lo
            sums = np.cumsum(size)
            rows = np.repeat(lo - (sums - size), size) + np.arange(sums[-1])
            pair = np.repeat(np.arange(len(lo)), size) * 257 + bwt[rows]
            pair = np.unique(pair)
            k, c = pair // 257, pair % 257
            k, c = k[c > 0], c[c > 0]
            # Rows of one symbol keep their order, so a symbol's rank is its place in ``held``.
            starts.append(np.searchsorted(held, c * (n + 1) + lo[k]))
            ends.append(np.searchsorted(held, c * (n + 1) + hi[k]))
        lo, hi = np.concatenate(starts), np.concatenate(ends)
        new = ~reached[hi]
        lo, hi = lo[new], hi[new]
        if len(hi) == 0:
            break
        hi, first = np.unique(hi, return_index=True)
        lo = lo[first]
        reached[hi] = True
    return reached[:n]


def repeats_among(ranges: list[bytes], length: int) -> list[np.ndarray]:
    """For each range its starts (offsets) whose ``length`` bytes occur at another start of any range."""
    sizes = np.fromiter(map(len, ranges), np.int64, len(ranges))
    data = np.frombuffer(b"\0".join(ranges) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1  # places of the end symbols
    symbols = data.astype(np.uint16) + 1
    symbols[ends] = 0
    left = np.repeat(ends, sizes + 1) - np.arange(len(data))
    order = sort_suffixes(symbols, left, length)
    short = short_prefixes(symbols, order, length)
    full = left[order] >= length
    pair = ~short[1:] & full[1:] & full[:-1]
    hit = np.zeros(len(data), bool)
    hit[order[1:][pair]] = True
    hit[order[:-1][pair]] = True
    return [np.flatnonzero(hit[e - n : max(e - n, e - length + 1)]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def runs_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, last) of consecutive numbers."""
    if len(starts) == 0:
        return []
    gap = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], gap + 1])].tolist(), starts[np.concatenate([gap, [len(starts) - 1]])].tolist(), strict=True))


def _decide(length: int):
    def decide(table: pa.Table) -> pa.Table:
        rows = table.select(["anchor", "c1", "c2"])
        found = repeats_among(table["bytes"].to_pylist(), length)
        at = [k for k, f in enumerate(found) for _ in runs_of(f)]
        runs = [r for f in found for r in runs_of(f)]
        out = rows.take(pa.array(at, pa.int64()))
        return out.append_column("lo", pa.array([a for a, _ in runs], pa.int32())).append_column("hi", pa.array([b for _, b in runs], pa.int32()))

    return decide


_CONTEXT = ["anchor", "c1", "c2"]


def repeated_spans(docs: DataFrame, text_col: str = "text", key_cols: list[str] | None = None, *, length: int = 400, gram: int = 128, shard_bytes: int = 4 << 20, log2_bits: int | None = None) -> DataFrame:
    """``k1, k2, spans``: the byte ranges [start, end) that repeat, merged, of the rows with such.

    ``k1, k2`` are the two 64-bit hashes of ``key_cols`` that ``row_keys`` gives.
    """
    spark = docs.sparkSession
    gram = min(gram, length)
    keyed = docs.select(*row_keys(docs, key_cols or docs.columns), F.col(text_col).cast("string").alias("text"))

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [ranges_of(t, length, gram) for t in bytes_of(b.column(2))]
            n = np.fromiter((len(f[0]) for f in found), np.int64, len(found))
            k1, k2 = (np.repeat(b.column(k).to_numpy(), n) for k in (0, 1))
            first, last, *hashes = (np.concatenate([f[k] for f in found]) for k in range(5))
            yield pa.record_batch([pa.array(k1), pa.array(k2), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), *map(signed, hashes)], ["k1", "k2", "s", "e", "anchor", "c1", "c2"])

    ranges = cut(keyed.mapInArrow(describe, "k1 long, k2 long, s int, e int, anchor long, c1 long, c2 long"), "ranges")
    twice = ranges.select("anchor").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    held = spark.sparkContext.broadcast(BitFilter.of(twice, "anchor", log2_bits))

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            yield b.filter(pa.array(bits.has(b.column(4).to_numpy().view(np.uint64))))

    ranges = cut(ranges.mapInArrow(shared, ranges.schema), "shared-ranges")
    distinct = ranges.groupBy(*_CONTEXT).agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "s", "e")).alias("one"))
    distinct = cut(distinct, "distinct-ranges")
    size = F.col("one.e") - F.col("one.s") + length
    anchors = distinct.groupBy("anchor").agg(F.count("*").alias("ranges"), F.sum("n").alias("all"), F.sum(size).alias("bytes")).where("ranges > 1")
    anchors = cut(anchors, "anchors")  # apart from the join, whose hot anchors can then be split
    open_ = cut(distinct.join(anchors.select("anchor", F.col("bytes").alias("total")), "anchor"), "open-ranges")

    # Equal ranges: all their starts repeat.
    equal = ranges.join(distinct.where("n > 1").select(*_CONTEXT), _CONTEXT).select("k1", "k2", F.col("s").alias("lo"), F.col("e").alias("hi"))

    # The bytes of the ranges left, once for each.
    wanted = spark.sparkContext.broadcast(BitFilter.of(open_, "c1", log2_bits))

    def carry(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for b in batches:
            rows = []
            for t in bytes_of(b.column(0)):
                first, last, anchor, c1, c2 = ranges_of(t, length, gram)
                for k in np.flatnonzero(bits.has(c1)).tolist():
                    name = (int(anchor[k].view(np.int64)), int(c1[k].view(np.int64)), int(c2[k].view(np.int64)))
                    if name not in seen:
                        if len(seen) < 200_000:
                            seen.add(name)
                        rows.append((*name, t[first[k] : last[k] + length]))
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.binary() if k == 3 else pa.int64()) for k in range(4)], [*_CONTEXT, "bytes"])

    carried = keyed.select("text").mapInArrow(carry, "anchor long, c1 long, c2 long, bytes binary")
    bytes_ = carried.join(open_.select(*_CONTEXT, "total"), _CONTEXT).dropDuplicates(_CONTEXT)
    bytes_ = cut(bytes_, "range-bytes")
    total = bytes_.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-2 * total // shard_bytes))
    small, large = bytes_.where(F.col("total") <= shard_bytes), bytes_.where(F.col("total") > shard_bytes)
    decided = small.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(_decide(length), "anchor long, c1 long, c2 long, lo int, hi int")

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, c1, c2, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                n = len(data) - length + 1
                w1, w2 = digests(data[k : k + length] for k in range(n))
                yield pa.record_batch([pa.array([x] * n, pa.int64()) for x in (a, c1, c2)] + [pa.array(np.arange(n, dtype=np.int32)), signed(w1), signed(w2)], [*_CONTEXT, "lo", "w1", "w2"])

    starts = large.select(*_CONTEXT, "bytes").mapInArrow(windows, "anchor long, c1 long, c2 long, lo int, w1 long, w2 long")
    often = starts.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    counted = starts.join(often, ["w1", "w2"]).select(*_CONTEXT, "lo", F.col("lo").alias("hi"))
    single = open_.where("n = 1").select(*_CONTEXT, "one.*")
    partly = decided.unionByName(counted).join(single, _CONTEXT).select("k1", "k2", (F.col("s") + F.col("lo")).alias("lo"), (F.col("s") + F.col("hi")).alias("hi"))
    runs = equal.unionByName(partly).select("k1", "k2", F.struct(F.col("lo").alias("start"), (F.col("hi") + length).alias("end")).alias("span"))
    schema = "k1 long, k2 long, spans array<struct<start:int,end:int>>"

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            out = []
            for spans in b.column(2).to_pylist():
                merged: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in spans):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                out.append([{"start": a, "end": z} for a, z in merged])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, kind)], ["k1", "k2", "spans"])

    # All runs of one text: bounded by the text.
    return runs.groupBy("k1", "k2").agg(F.collect_list("span").alias("spans")).mapInArrow(merge, schema)


def row_keys(docs: DataFrame, key_cols: list[str]):
    cols = [F.col(c) for c in key_cols]
    return F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(7), *reversed(cols)).alias("k2")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per input row: ``id, n_bytes, spans, kept`` (binary)."""
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(narrow, "text", ["id", "text"], **params)
    joined = narrow.select(*row_keys(narrow, ["id", "text"]), "id", "text").join(spans, ["k1", "k2"], "left").select("id", "text", "spans")
    schema = T.StructType([narrow.schema["id"], *T.StructType.fromDDL("n_bytes long, spans array<struct<start:int,end:int>>, kept binary").fields])

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, kept, spans = [], [], b.column(2).to_pylist()
            for text, gone in zip(bytes_of(b.column(1)), spans, strict=True):
                n.append(len(text))
                at, parts = 0, []
                for s in gone or []:
                    parts.append(text[at : s["start"]])
                    at = s["end"]
                kept.append(b"".join([*parts, text[at:]]))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array([s or [] for s in spans], b.schema.field(2).type), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(keep, schema)
