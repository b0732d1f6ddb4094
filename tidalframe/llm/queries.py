"""The queries opN_<name>: each operator over its whole table, as the contract asks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, chat, decontaminate, exact_dedup, extract, language, line_dedup, ngram_join, quality, repeats, search, spelling, toxicity
from .toxicity import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(crc_mod("doc_id", 4) != 2), "toxic")
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))
    return marked.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.where(crc_mod("doc_id", 5) != 0))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=400)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(crc_mod("doc_id", 3) != 1), "quality")
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: its messages in reply order, as chat lines, and their digest."""
    ordered = chat.conversations(chat.link_messages(_table(spark, sf_dir, "conversations")))
    # The chat template: a role marker, the content, an end marker.
    lines = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("<|end|>\n"))), "")
    return ordered.select(F.col("conv").cast("long").alias("conv_id"), "n_messages", "n_quoted", F.sha2(lines, 256).alias("chat_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_report(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ends = b.column(1).values.to_numpy().astype("<u4"), b.column(1).offsets.to_numpy()
            of_ids = [hashlib.sha256(ids[a:z].tobytes()).hexdigest() for a, z in zip(ends, ends[1:], strict=False)]
            decoded = [hashlib.sha256(x).hexdigest() for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(of_ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField("doc_id", coded.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return coded.mapInArrow(digests, schema)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.count_words(_table(spark, sf_dir, "documents"), min_chars=7, min_count=2, reading=spelling.drop_one_in(31))
    return spelling.spelling_forms(counts, ratio=10)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = extract.extract(pages, extract.train(pages), keep=("url",))
    return found.select(F.col("id").alias("page_id"), "url", F.col("main_text").alias("text"), "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_language, op4_decontaminate, op5_repeats, op6_quality, op7_ngram_join, op8_chat, op9_line_dedup, op10_byte_bpe, op11_spelling, op12_search, op13_extract)
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op4_decontaminate": """
        WITH iw AS (
            SELECT CAST(item_id AS VARCHAR) AS item,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark),
        win AS (
            SELECT DISTINCT item, array_to_string(w[k : k + 9], ' ') AS win, least(len(w), 10) AS n
            FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(k) WHERE len(w) > 0),
        dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents),
        dwin AS (
            SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win
            FROM dw, (SELECT DISTINCT n FROM win) AS s, unnest(range(1, len(w) - n + 2)) AS r(k)),
        hit AS (SELECT d.doc_id, d.k, d.n, w.item FROM dwin AS d JOIN win AS w ON d.win = w.win AND d.n = w.n),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, k, n FROM hit), unnest(range(k, k + n)) AS r(p) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS k
            FROM documents),
        keyed AS (
            SELECT doc_id, k, line,
                   translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN common AS c ON keyed.key = c.key GROUP BY doc_id""",
    "op12_search": """
        WITH dt AS (
            SELECT doc_id, row_id, unnest(w) AS term, len(w) AS n
            FROM (SELECT doc_id, row_number() OVER () AS row_id,
                         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
                  FROM documents)),
        qt AS (
            SELECT item_id, term, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
            GROUP BY item_id, term),
        total AS (SELECT count(DISTINCT row_id) AS nd, count(*) AS nt FROM dt),
        tf AS (SELECT doc_id, row_id, term, max(n) AS n, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM qt) GROUP BY doc_id, row_id, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * max(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
        s AS (
            SELECT item_id, doc_id, row_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt)))) AS BIGINT) AS score
            FROM qt JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, doc_id, row_id),
        ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
}
