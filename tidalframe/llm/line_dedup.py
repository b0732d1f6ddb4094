"""Lines that many documents share, found through a sharded minimal perfect hash.

1. Tasks count in how many of their documents each line key occurs (one count
   a key and task, so a line that a third of all documents carry is a handful
   of rows), and the counts are summed by a 128-bit hash of the key.
2. The hashes of the lines that reach the threshold are dealt to shards. Each
   shard becomes a minimal perfect hash (hash and displace): ``n`` keys take
   ``n`` slots; beside it lie an array of 64-bit fingerprints and an array of
   counts. A shard holds a bounded number of keys.
3. Documents probe the arrays; lines are never joined or shuffled. Shards are
   broadcast in blocks of at most ``block_bytes``; where there are more, the
   documents pass once for each block.

Defined results: null or empty text is one empty line; a key shorter than
``min_chars`` never counts; a line repeated in a document counts once for it;
the same row twice counts as two documents; empty tables give empty results.
Further columns are passed through untouched by ``drop_common_lines``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, cut, fresh, mix, signed

_BLANK = b" \t\n\x0b\x0c\r"
_C = np.uint64(0x9E3779B97F4A7C15)


def key_of(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()


def _n_chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def _hashes(keys: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


def _slot(h: np.ndarray, seed: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return mix(h ^ (seed.astype(np.uint64) * _C)) % np.asarray(n, np.uint64)


def build_shard(h: np.ndarray, fingerprint: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Displacements a bucket, and the fingerprints and counts by slot.

    A bucket of several keys stores the first seed that sends its keys to free
    slots, a bucket of one key minus its slot and one.
    """
    n = len(h)
    buckets = max(1, (n + 3) // 4)
    of = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(buckets + 1))
    size = np.diff(starts)
    seeds, slot, free = np.zeros(buckets, np.int64), np.full(n, -1, np.int64), np.ones(n, bool)
    for b in np.argsort(-size, kind="stable"):
        mine = order[starts[b] : starts[b + 1]]
        if len(mine) < 2:
            break
        first = 0
        while True:
            tries = np.arange(first, first + 64)
            to = _slot(h[mine][None, :], tries[:, None], n).astype(np.int64)
            good = free[to].all(axis=1)
            if len(mine) > 1:
                s = np.sort(to, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b], slot[mine] = first + k, to[k]
                free[to[k]] = False
                break
            first += 64
    left = iter(np.flatnonzero(free))
    for b in np.flatnonzero(size == 1):
        mine = order[starts[b]]
        slot[mine] = next(left)
        seeds[b] = -slot[mine] - 1
    fp, cnt = np.empty(n, np.uint64), np.empty(n, np.uint32)
    fp[slot], cnt[slot] = fingerprint, np.minimum(count, np.iinfo(np.uint32).max)
    return seeds, fp, cnt


class Shards:
    """Some of the shards, as flat arrays that a batch of lines probes at once."""

    def __init__(self, n_shards: int, rows: list[tuple[int, bytes, bytes, bytes]]):
        self.n_shards = n_shards
        self.here = np.zeros(n_shards, bool)
        self.b_at, self.b_n, self.s_at, self.s_n = (np.zeros(n_shards, np.int64) for _ in range(4))
        seeds, fps, counts, b, s = [], [], [], 0, 0
        for shard, x, y, z in rows:
            x, y, z = np.frombuffer(x, np.int64), np.frombuffer(y, np.uint64), np.frombuffer(z, np.uint32)
            self.here[shard] = True
            self.b_at[shard], self.b_n[shard], self.s_at[shard], self.s_n[shard] = b, len(x), s, len(y)
            b, s = b + len(x), s + len(y)
            seeds.append(x), fps.append(y), counts.append(z)
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.seeds, self.fps, self.counts = cat(seeds, np.int64), cat(fps, np.uint64), cat(counts, np.uint32)

    def counts_of(self, h: np.ndarray) -> np.ndarray:
        """The document count of each line hash; 0 for lines that aren't held."""
        out = np.zeros(len(h), np.int64)
        shard = (h[:, 1] % np.uint64(self.n_shards)).astype(np.int64)
        at = np.flatnonzero(self.here[shard])
        if len(at) == 0:
            return out
        shard, h1, h2 = shard[at], h[at, 0], h[at, 1]
        seed = self.seeds[self.b_at[shard] + (h1 % self.b_n[shard].astype(np.uint64)).astype(np.int64)]
        slot = np.where(seed < 0, -seed - 1, _slot(h1, np.maximum(seed, 0), self.s_n[shard]).astype(np.int64)) + self.s_at[shard]
        same = self.fps[slot] == h2
        out[at[same]] = self.counts[slot[same]]
        return out


def line_counts(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """``h1, h2, n``: a line key's hash and the number of documents that have it."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            h = _hashes(seen)
            return pa.record_batch([signed(h[:, 0]), signed(h[:, 1]), pa.array(list(seen.values()), pa.int64())], ["h1", "h2", "n"])

        for b in batches:
            for text in bytes_of(b.column(0)):
                seen.update({k for k in map(key_of, text.split(b"\n")) if len(k) >= min_chars and (min_chars < 2 or _n_chars(k) >= min_chars)})
                if len(seen) > 200_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "h1 long, h2 long, n long")
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _build(table: pa.Table) -> pa.Table:
    h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    seeds, fps, counts = build_shard(h1, h2, table["n"].to_numpy())
    return pa.table({"shard": table["shard"][:1], "size": pa.array([seeds.nbytes + fps.nbytes + counts.nbytes], pa.int64())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in (("seeds", seeds), ("fps", fps), ("counts", counts))})


def common_line_marks(
    docs: DataFrame, text_col: str = "text", *, min_docs: int = 10, min_chars: int = 1, shard_keys: int = 1 << 15, block_bytes: int = 64 << 20
) -> tuple[DataFrame, str]:
    """``docs`` with a column of dropped line numbers (ascending), and its name."""
    spark, mark = docs.sparkSession, fresh(docs, "_dropped")
    keys = cut(line_counts(docs, text_col, min_chars).where(F.col("n") >= min_docs), "line-counts")
    n_shards = max(1, -(-keys.count() // shard_keys))
    schema = "shard int, size long, seeds binary, fps binary, counts binary"
    # h1 chooses bucket and slot, so the shard is h2's: it is also the fingerprint.
    dealt = keys.withColumn("shard", _unsigned_mod("h2", n_shards))
    shards = cut(dealt.groupBy("shard").applyInArrow(_build, schema), "line-shards")
    blocks, room = [[]], block_bytes
    for shard, size in sorted((r.shard, r.size) for r in shards.select("shard", "size").collect()):
        if size > room and blocks[-1]:
            blocks.append([])
            room = block_bytes
        blocks[-1].append(shard)
        room -= size
    out = docs.withColumn(mark, F.lit(None).cast("array<int>"))
    for k, block in enumerate(blocks):
        rows = [tuple(r) for r in shards.where(F.col("shard").between(block[0], block[-1])).select("shard", "seeds", "fps", "counts").collect()] if block else []
        held = spark.sparkContext.broadcast((n_shards, rows))
        out = out.mapInArrow(_probe(held, docs.columns.index(text_col), min_chars, min_docs), out.schema)
        if k < len(blocks) - 1:
            out = cut(out, "line-pass")
    return out, mark


def _unsigned_mod(column: str, n: int):
    """``column`` read as unsigned, modulo ``n``."""
    c = F.col(column)
    return F.pmod(F.pmod(c, F.lit(n)) + F.when(c < 0, F.lit(pow(2, 64, n))).otherwise(F.lit(0)), F.lit(n)).cast("int")


def _probe(held, at: int, min_chars: int, min_docs: int):
    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(*held.value)
        for b in batches:
            old = b.column(b.num_columns - 1).to_pylist()
            marks: list[list[int]] = []
            for text, before in zip(bytes_of(b.column(at)), old, strict=True):
                keys = [key_of(x) for x in text.split(b"\n")]
                hit = shards.counts_of(_hashes(keys)) >= min_docs
                if before:
                    hit[before] = True
                marks.append([int(k) for k in np.flatnonzero(hit) if len(keys[k]) >= min_chars and (min_chars < 2 or _n_chars(keys[k]) >= min_chars)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(marks, pa.list_(pa.int32()))], names=b.schema.names)

    return probe


def drop_common_lines(docs: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """``docs`` with the common lines gone from the text, columns unchanged.

    A null text stays null.
    """
    marked, mark = common_line_marks(docs, text_col, **params)
    at = F.col(mark)
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda _, k: ~F.array_contains(at, k)), "\n")
    return marked.withColumn(text_col, F.when(F.size(at) > 0, kept).otherwise(F.col(text_col))).drop(mark)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` for every row of ``docs``."""
    marked, mark = common_line_marks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", **params)
    schema = T.StructType([marked.schema["doc_id"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(bytes_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                lines, gone = text.split(b"\n"), set(gone)
                n_lines.append(len(lines)), n_dropped.append(len(gone))
                kept.append(b"\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text)
            yield pa.record_batch([b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return marked.select("doc_id", "text", mark).mapInArrow(keep, schema)
