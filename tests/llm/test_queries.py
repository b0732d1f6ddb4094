"""The registered queries: those with SQL against DuckDB, all against their contract's columns and the documents' identifiers."""

from __future__ import annotations

import hashlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidalframe.llm import bpe
from tidalframe.llm.queries import ORACLES, QUERIES

from .test_dedup import brute_components, brute_repeats

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")
COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op3_language": "doc_id held_out lang_pred score",
    "op4_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op5_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op6_quality": "doc_id held_out score predicted",
    "op7_ngram_join": "doc_id n_shingles component_id",
    "op9_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op10_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def results(spark):
    kept: dict = {}

    def of(name):
        if name not in kept:
            df = QUERIES[name](spark, str(SF))
            kept[name] = (df.dtypes, df.collect())
        return kept[name]

    return of


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(results, rows, name):
    types, got = results(name)
    assert [c for c, _ in types][: len(COLUMNS[name].split())] == COLUMNS[name].split()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for c, t in types:
        if c.startswith("n_") or c == "group_size":
            assert t == "bigint"
        if c in ("held_out", "kept", "contaminated"):
            assert t == "boolean"
        if c == "score":
            assert t == "double" and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(results, name):
    db = duckdb.connect()
    for p in SF.glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    types, got = results(name)
    cols = sorted(c for c, _ in types)
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in cols)) for r in got)


def test_repeats_by_counting(results, rows):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: (n, n - len(kept), sha(kept)) for (i, n, kept) in brute_repeats(rows, 400)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in results("op5_repeats")[1]} == want
    assert all((r.n_spans > 0) == (r.n_removed > 0) for r in results("op5_repeats")[1])


def test_join_by_pairs(results, rows):
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in results("op7_ngram_join")[1]} == set(brute_components(rows, 3, 90))


def test_tokens_as_the_library(results, rows):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in results("op10_byte_bpe")[1]} == want


def test_chat_keeps_every_message(spark):
    got = QUERIES["op8_chat"](spark, str(SF)).collect()
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = {r.conv_id: r["count"] for r in table.groupBy("conv_id").count().collect()}
    assert {r.conv_id: r.n_messages for r in got} == want
