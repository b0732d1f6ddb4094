"""Helpers that the training-data operators share.

* ``cut`` writes a table to the shared folder and reads it back, so that a lost
  executor costs a re-read and not the whole lineage.
* ``BitFilter`` is a membership filter of a bounded number of bits. It is the
  only thing about a corpus that the operators broadcast: 16 bits a key or more
  up to 64 MB; beyond that it passes more rows on, and the exact step behind it
  decides.
* ``words_of`` and friends work on UTF-8 bytes: a table lookup and a split.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
#: Folder and, if it is in the catalogue, table name of each written table.
_written: list[tuple[str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``.

    Where the session names none and runs in one process, a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tidalframe-"))
    return _own_dir[0]


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidalframe/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((path, None))
    return spark.read.schema(df.schema).parquet(path)


def cut_bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Like ``cut``, bucketed by ``key``: a later join by ``key`` need not shuffle these rows again."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tidalframe/{name}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    _written.append((path, name))
    return spark.table(name)


def written_so_far() -> int:
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables written after the first ``since``, but not what ``keep`` reads; all other readers must be done."""
    needed = keep.inputFiles() if keep is not None else []
    jvm, left = spark.sparkContext._jvm, []
    for path, name in _written[since:]:
        if any(path.rpartition("/")[2] in f for f in needed):
            left.append((path, name))
            continue
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _written[since:] = left


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Hand Python at most ``most`` bytes at a time, in this session from now on."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > most:
        spark.conf.set(key, str(most))


@contextmanager
def held_batches(spark: SparkSession, most: int = 16 << 20) -> Iterator[None]:
    """Inside, Python gets at most ``most`` bytes at a time (one row at least); then the session is as it was.

    For what is written inside: a plan that runs later takes the setting of then.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    small_batches(spark, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bytes_of(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


#: Every ASCII byte but 0-9 and a-z becomes a space, A-Z become a-z.
_WORD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text."""
    return text.translate(_WORD).split()


def tokens_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased."""
    return text.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash:
    """64-bit hashes of words, remembered for a bounded number of them."""

    def __init__(self, most: int = 100_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, n: int, short: bool = True) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order.

    With fewer words and ``short``, the whole sequence is the one shingle;
    no words, no shingles.
    """
    if len(hashes) == 0:
        return hashes
    if len(hashes) < n:
        if not short:
            return hashes[:0]
        n = len(hashes)
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * _ODD + hashes[k : k + len(out)])
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class BitFilter:
    """A two-probe Bloom filter of ``2 ** log2_bits`` bits."""

    def __init__(self, words: np.ndarray, log2_bits: int):
        self.words, self.log2_bits = words, log2_bits

    @staticmethod
    def places(hashes: np.ndarray, log2_bits: int) -> tuple[np.ndarray, np.ndarray]:
        down = np.uint64(64 - log2_bits)
        return mix(hashes) >> down, mix(hashes ^ _ODD) >> down

    def __contains__(self, _):
        raise TypeError("use has(array)")

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes, self.log2_bits):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    @classmethod
    def of(cls, df: DataFrame, column: str, log2_bits: int | None = None, most: int = 29, per_key: int = 16) -> BitFilter:
        """Filled by the executors: they reduce hashes to 64-bit pieces of the

        filter, combined by OR; the driver gets at most ``2 ** (log2_bits - 6)``
        pieces. By default ``per_key`` bits or more a row, ``2 ** most`` at most: 64 MB
        whatever the number of rows.
        """
        if log2_bits is None:
            df = cut(df.select(column), "filter-keys")
            log2_bits = min(most, max(16, (per_key * df.count()).bit_length()))

        def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = None
            for b in batches:
                h = b.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
                if bits is None:
                    bits = np.zeros(1 << (log2_bits - 6), np.uint64)
                for at in cls.places(h, log2_bits):
                    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            if bits is not None:
                k = np.flatnonzero(bits)
                yield pa.record_batch([pa.array(k), signed(bits[k])], ["k", "bits"])

        rows = df.select(F.col(column).cast("long")).mapInArrow(pieces, "k long, bits long").groupBy("k").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(1 << (log2_bits - 6), np.uint64)
        words[rows["k"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        return cls(words, log2_bits)
