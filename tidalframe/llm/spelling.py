"""Spelling variant grouping by a symmetric-delete join.

Every word emits a key for itself and one for each of its distinct single
deletions; words that share a key are joined, the pair is verified to be at
distance one exactly, each word's forms are aggregated, and roots are joined
along the chain of forms.

* A key is a 64-bit hash, computed for all deletions of a word from its prefix
  sums, so a word of ``k`` letters costs ``k`` numbers and never ``k`` strings.
* A deletion carries the run of equal letters that it can be taken from. Two
  words of the same length with a common deletion differ by one replaced
  letter exactly if these runs overlap, so the join emits near pairs only, and
  each once; a hash collision is rejected by the comparison of the words.
* A key cannot be hot without limit: a deletion of ``k`` letters is shared by at
  most ``(k + 1) * alphabet`` distinct words. Repeated words are counted before
  anything is shuffled.

* Words, pairs and roots grow with the corpus, so they are joined by sorting
  (``merge``): a compressed table below Spark's broadcast bound is many times
  larger in the driver that would build it.

Cases: null, empty and letterless texts give no words; repeated rows count
again; an empty table gives no rows; ties of forms go to the word that is first
in code-point order; words may be of any length; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, mix, signed

#: Words that a task counts before it hands them on.
_HELD = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: From the identifier of a row (as text) and one of its runs to the word that is counted.
Reading = Callable[[str, str], str]


def drop_one_in(every: int) -> Reading:
    """Lose one letter of each run whose checksum with the row's identifier is divisible by ``every``."""

    def read(row: str, run: str) -> str:
        h = zlib.crc32(f"{row}:{run}".encode())
        return run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]

    return read


def count_words(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 7, min_count: int = 2, reading: Reading | None = None) -> DataFrame:
    """``word, n``: runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased, of ``min_chars`` letters and ``min_count`` occurrences or more.

    ``reading`` may change a run, given its row's identifier (empty if null), before it is counted.
    """
    # A run of fewer letters cannot become a longer word, so it is not even looked at.
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), strict=True):
                found = Counter(runs.findall(text.lower().decode("utf-8", "replace")))
                if reading is None:
                    held.update(found)
                else:
                    for run, n in found.items():
                        word = reading(row or "", run)
                        if len(word) >= min_chars:
                            held[word] += n
                if len(held) > _HELD:
                    yield out()
        if held:
            yield out()

    parts = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word itself and each distinct deletion: row of the word, key, first and last place of the run (-1 for the word itself), own."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(letters)) - starts[row]
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max(initial=0)), _BASE)]))
    terms = mix(letters + np.uint64(1)) * powers[at]
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])  # wraps modulo 2 ** 64, as all sums here
    whole = before[starts + sizes] - before[starts]
    # The letters behind the deleted one move one place to the front.
    less = (before[:-1] - before[starts[row]]) + (before[starts[row] + sizes[row]] - before[1:]) * _BACK
    first = np.ones(len(letters), bool)
    first[1:] = (letters[1:] != letters[:-1]) | (at[1:] == 0)
    head = np.flatnonzero(first)
    ends = np.append(head[1:], len(letters)) - 1
    none = np.full(len(words), -1)
    key = np.concatenate([mix(whole ^ mix(sizes.astype(np.uint64))), mix(less[head] ^ mix((sizes[row[head]] - 1).astype(np.uint64)))])
    return np.concatenate([np.arange(len(words)), row[head]]), key, np.concatenate([none, at[head]]), np.concatenate([none, at[ends]]), np.arange(len(words) + len(head)) < len(words)


def _emitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, ids = b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(np.cumsum(sizes) // 1_000_000)) + 1):
            row, key, first, last, own = _keys([words[k] for k in part])
            yield pa.record_batch([signed(key), pa.array(ids[part][row]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(own)], ["key", "id", "first", "last", "own"])


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: identifiers of all words at distance one, each pair once, from ``id, word`` of distinct words."""
    keys = words.select("id", "word").mapInArrow(_emitted, "key long, id long, first int, last int, own boolean")
    a, b = keys.alias("a"), keys.alias("b")
    # A word and another's deletion: one letter more. Two deletions: the same letter's place, if the runs overlap.
    one_more = F.col("a.own") & ~F.col("b.own")
    replaced = ~F.col("a.own") & ~F.col("b.own") & (F.col("a.id") < F.col("b.id")) & (F.col("a.first") <= F.col("b.last")) & (F.col("b.first") <= F.col("a.last"))
    shared = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (one_more | replaced)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    named = shared.join(words.select(F.col("id").alias("a"), F.col("word").alias("wa")).hint("merge"), "a").join(words.select(F.col("id").alias("b"), F.col("word").alias("wb")).hint("merge"), "b")
    return named.where(F.levenshtein("wa", "wb", 1) == 1).select("a", "b")


def spelling_forms(counts: DataFrame, *, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``word, n`` (distinct words).

    ``n_near``: other words at distance one. ``form``: the most frequent of them
    (ties: the first in code-point order), if at least ``ratio`` times as
    frequent, else null. ``root``: the end of the chain of forms. A chain's counts
    grow by ``ratio`` at each step, so its length is logarithmic in the counts,
    and the rounds that join roots, which double their reach, are few.
    """
    words = cut(counts.where("word is not null").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    pairs = cut(near_pairs(words), "near-pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("id", "near")
    near = both.join(words.select(F.col("id").alias("near"), F.col("word").alias("form"), F.col("n").alias("form_n")).hint("merge"), "near")
    best = near.groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form", "near")).alias("best"))
    found = words.join(best.hint("merge"), "id", "left").withColumn("has", -F.col("best.less") >= ratio * F.col("n"))
    held = cut(
        found.select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("has"), F.col("best.form")).alias("form"), F.when(F.col("has"), -F.col("best.less")).alias("form_n"), F.when(F.col("has"), F.col("best.near")).alias("to"),
        ),
        "forms",
    )
    roots = _roots(held.where("to is not null").select("id", "to"))
    ends = roots.join(held.select(F.col("id").alias("to"), F.col("word").alias("root")).hint("merge"), "to").select("id", "root")
    return held.join(ends.hint("merge"), "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """``id, to``: where each chain of links ends; every round doubles how far a link reaches."""
    while True:
        onward = links.select(F.col("id").alias("to"), F.col("to").alias("further"))
        step = cut(links.join(onward.hint("merge"), "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "roots")
        links = step.select("id", "to")
        if step.where("moved").isEmpty():
            return links
