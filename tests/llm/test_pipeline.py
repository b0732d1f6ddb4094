"""The pipeline against a plain version of the same rules, on the smallest tables."""

from __future__ import annotations

import hashlib
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tidalframe.llm import bpe, toxicity

from .test_dedup import brute_components
from .test_models_and_tokens import brute_windows

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_run_against_plain_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), "toxic")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    scores = model.scores([t for _, t in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s < corpus_pipeline.TOXIC]
    keep: dict[str, int] = {}
    for i, t in rows:
        keep[t or ""] = max(i, keep.get(t or "", i))
    rows = [(i, t) for i, t in rows if keep[t or ""] == i]
    least = {i: c for i, _, c in brute_components(rows, 5, 80)}
    rows = [(i, t) for i, t in rows if least[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {k[0] for k in brute_windows(rows, items, 10) if not k[2]}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: enc.encode_ordinary(t or "") for i, t in rows if i in clean}
    got = {r.doc_id: list(r.token_ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_last_stage_decodes(spark):
    texts = [(1, "Plain words, twice: plain words."), (2, "éß ñ 你好 \n\t 12"), (3, ""), (4, None)]
    got = corpus_pipeline.encode(spark, spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts}


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontaminate", "byte_bpe"]
