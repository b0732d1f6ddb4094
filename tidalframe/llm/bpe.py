"""Byte-level BPE by a global shuffle of distinct words.

1. Tasks split texts into pre-tokens. A chunk of documents becomes one row: its
   distinct words, dealt to buckets by hash, and every pre-token's position as
   the number of its word, compressed. So a position costs about a byte and a
   half, and a word is sent once for each chunk, not for each occurrence.
2. Words are shuffled by bucket: all rows of a word meet in one task, which
   encodes it once and gives every chunk its ids.
3. Ids join back by chunk, and each document is reassembled by position.

Decoding replaces ids by the bytes of the token table. Table and pattern are
parameters; a table is bounded by its vocabulary (some MB) and broadcast.

Defined results: null text is encoded as empty; empty text has no ids; words
of any length are encoded whole; repeated rows repeat in the result; an empty
table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_bucketed, small_batches


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a file of lines ``base64-token rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbours of least rank, leftmost first, until none is left.

    A heap of candidate merges over a linked list of parts, so a word of any
    length takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    start, end, after, before = list(range(n)), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[start[i] : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, e, f = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[i] != e or end[j] != f:
            continue
        end[i], after[i], alive[j] = f, after[j], False
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[start[i] : end[i]]])
        i = after[i]
    return out


def pack(numbers: np.ndarray) -> bytes:
    """Compressed byte planes: small numbers leave the high planes empty."""
    planes = np.ascontiguousarray(numbers, np.uint32).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def pack_lists(flat: bytes, sizes: np.ndarray) -> bytes:
    """Byte strings as their sizes and their bytes, each compressed."""
    head = pack(sizes)
    return len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor(level=3).compress(flat)


def unpack_lists(data: bytes) -> tuple[bytes, np.ndarray]:
    n = 8 + int.from_bytes(data[:8], "little")
    return zstandard.ZstdDecompressor().decompress(data[n:]), unpack(data[8:n]).astype(np.int64)


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", *,
    chunk_tokens: int = 1_500_000, chunk_words: int = 130_000, buckets: int = 256, most_known: int = 200_000,
) -> DataFrame:
    """``id, token_ids array<int>`` for every row of ``docs``.

    ``chunk_words`` and ``chunk_tokens`` bound a chunk (one document at least),
    ``most_known`` the words a task remembers at a time. ``buckets`` (at most
    65536) is how finely words are dealt; more suit larger clusters.
    """
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = narrow.schema["id"]
    chunk_schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_type.dataType)), *T.StructType.fromDDL("lens array<long>, positions binary, bucket_of binary, words array<struct<bucket:int,words:binary>>").fields])

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, part, seq = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        ids, lens, flat, known = [], [], array("I"), {}

        def out() -> pa.RecordBatch:
            at = np.frombuffer(flat, np.uint32) if flat else np.zeros(0, np.uint32)
            # Frequent words get small numbers; within a bucket, words stand in this order.
            order = np.argsort(-np.bincount(at, minlength=len(known)), kind="stable")
            number = np.empty(len(known), np.uint32)
            number[order] = np.arange(len(known), dtype=np.uint32)
            words = [w.encode() for w in known]
            words = [words[k] for k in order]
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
            by, used = np.argsort(bucket, kind="stable"), np.unique(bucket)
            ends = np.searchsorted(bucket[by], used, side="right").tolist()
            rows = [(b, [words[k] for k in by[lo:hi]]) for b, lo, hi in zip(used.tolist(), [0, *ends[:-1]], ends, strict=True)]
            packed = [{"bucket": b, "words": pack_lists(b"".join(ws), np.fromiter(map(len, ws), np.uint32, len(ws)))} for b, ws in rows]
            columns = [pa.array([(part << 32) + seq], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([lens], pa.list_(pa.int64())), pa.array([pack(number[at])], pa.binary()), pa.array([pack(bucket)], pa.binary()), pa.array([packed], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])))]
            return pa.record_batch(columns, chunk_schema.names)

        for b in batches:
            kind = b.schema.field(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = find(text) if text else []
                ids.append(i), lens.append(len(words))
                for w in set(words).difference(known):
                    known[w] = len(known)
                flat.extend(map(known.__getitem__, words))
                if len(flat) >= chunk_tokens or len(known) >= chunk_words:
                    yield out()
                    seq += 1
                    ids, lens, flat, known = [], [], array("I"), {}
        if ids:
            yield out()

    table = spark.sparkContext.broadcast(ranks)

    def encode_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known, here = table.value, {}, None
        for b in batches:
            for chunk, bucket, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != here:  # rows come bucket by bucket: its words are done
                    known, here = {}, bucket
                flat, size = unpack_lists(packed)
                ends, out = np.cumsum(size).tolist(), []
                for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                    w = flat[lo:hi]
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= most_known:
                            known.clear()
                        ids = known[w] = np.asarray(encode_word(w, ranks), np.uint32).tobytes()
                    out.append(ids)
                n = np.fromiter(map(len, out), np.uint32, len(out)) // 4
                planes = np.frombuffer(b"".join(out), np.uint8).reshape(-1, 4).T
                coded = pack_lists(np.ascontiguousarray(planes).tobytes(), n)
                yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([coded], pa.binary())], ["chunk", "bucket", "coded"])

    split_up = narrow.mapInArrow(split, chunk_schema)
    # Chunks stay where they are written: only words and ids travel.
    homes = min(50_000, max(2, 2 * split_up.rdd.getNumPartitions()))
    chunks = cut_bucketed(split_up, "bpe-chunks", "chunk", homes)
    words = chunks.select("chunk", F.inline("words")).select("chunk", "bucket", "words")
    coded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(encode_words, "chunk long, bucket int, coded binary")
    coded = coded.repartition(homes, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "coded"))).alias("coded"))
    both = chunks.select("chunk", "ids", "lens", "positions", "bucket_of").join(coded, "chunk", "left")

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, lens, at, bucket, coded = (b.column(c)[r] for c in range(1, 6))
                bucket = unpack(bucket.as_py())
                parts = [unpack_lists(x["coded"]) for x in coded.as_py() or []]
                tokens = [np.ascontiguousarray(np.frombuffer(f, np.uint8).reshape(4, -1).T).view(np.int32).ravel() for f, _ in parts]
                # Words lie bucket by bucket here; the numbers of positions are those of the whole chunk.
                by = np.argsort(bucket, kind="stable")
                size = np.empty(len(by), np.int64)
                start = np.empty(len(by), np.int64)
                n = np.concatenate([s for _, s in parts]) if parts else np.zeros(0, np.int64)
                size[by], start[by] = n, np.cumsum(n) - n
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
                at = unpack(at.as_py()).astype(np.int64)
                lens = np.asarray(lens.as_py(), np.int64)
                bounds, ids = np.concatenate([[0], np.cumsum(lens)]), ids.values
                lo = 0
                while lo < len(ids):  # some hundred thousand words at a time
                    hi = min(len(ids), max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 300_000)) - 1))
                    mine = at[bounds[lo] : bounds[hi]]
                    n = size[mine]
                    ends = np.cumsum(n)
                    out = flat[np.repeat(start[mine] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
                    ends = np.concatenate([[0], ends])[bounds[lo : hi + 1] - bounds[lo]]
                    yield pa.record_batch([ids[lo:hi], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))], ["id", "token_ids"])
                    lo = hi

    schema = T.StructType([id_type, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return both.mapInArrow(assemble, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "token_ids") -> DataFrame:
    """``encoded`` with the column ``decoded`` (binary); null ids decode to null.

    An id that the table lacks is an error.
    """
    table = encoded.sparkSession.sparkContext.broadcast({v: k for k, v in ranks.items()})
    at = encoded.columns.index(ids_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = table.value.__getitem__
        for b in batches:
            ids, out = b.column(at), []
            flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            for k, known in enumerate(ids.is_valid().to_pylist()):
                out.append(b"".join(map(token, flat[ends[k] : ends[k + 1]].tolist())) if known else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(join, schema)
