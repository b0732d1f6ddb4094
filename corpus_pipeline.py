"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from tidalframe.llm.common import cut, fresh, release, small_batches, written_so_far

#: Bytes that Python gets at a time, from the first stage on: workers are reused and keep what the largest batch took.
BATCH = 2 << 20
#: Documents of this score or more are toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels, does not reject."""
    small_batches(spark, BATCH)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, score = toxicity.train(docs, labels, "toxic"), fresh(docs, "_toxicity")
    return toxicity.score(docs, model, out_col=score).where(F.col(score) < TOXIC).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of equal text, that of largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard similarity 0.8 of five-word shingles."""
    return ngram_join.drop_near_duplicates(docs, n=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, token_ids, n_tokens, decoded_sha256`` of the documents that are left: the digest is that of the bytes decoded from the ids."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(coded.select(F.col("id").alias("doc_id"), "token_ids"), ranks)
    return decoded.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("decontaminate", drop_benchmark), ("byte_bpe", encode)]

#: The learnt toxicity scores are not SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and reread, what it needed is deleted."""
    before = written_so_far()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, before, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
