"""Decontamination reads each text once, and its passages hide no window."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from tidalframe.llm import decontaminate

from .test_models_and_tokens import brute_windows


def test_texts_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(k, f"t{k} one two three four five") for k in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    found = decontaminate.contamination(docs.withColumn("text", F.udf(read, "string")("text")), items)
    assert found.where(F.size("spans") == 1).count() == 50
    assert seen.value == 50


def test_few_words_against_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice("aAbé") for _ in range(n))
    rows = [(k, make(rng.randint(0, 60)) + rng.choice([" z ", " "]) + make(rng.randint(0, 60))) for k in range(150)]
    items = [(k, make(rng.choice([2, 3, 4, 6, 7, 9, 10, 11, 13]))) for k in range(40)]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.id, r.n_words, sum(s["end"] - s["start"] for s in r.spans), tuple(r["items"])) for r in got) == brute_windows(rows, items, 10)
