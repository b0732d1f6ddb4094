"""Scores recomputed word by word, n-gram by n-gram; cases that the trained models must take; the pipeline on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidalframe.llm import labelled, language, quality, toxicity
from tidalframe.llm.common import fresh

from .test_models_and_tokens import toxic_corpus

# ---------------------------------------------------------------- toxicity


def test_toxicity_margin_word_by_word():
    texts, labels = toxic_corpus(200, 3)
    m = toxicity.fit(texts, labels, prior=0.25)

    def weight(word):
        rows, _ = toxicity.grams_of([word], len(m.weights))
        return float(np.mean(m.weights[rows]))

    def margin(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        if not words:
            return m.bias
        p, starts = m.passage, [0]
        if len(words) > p:
            starts = [*range(0, len(words) - p, p // 2), len(words) - p]
        best = -math.inf
        for s in starts:
            total, bag = 0.0, words[s : s + p]
            for k, w in enumerate(bag):
                if w not in words[max(0, s + k - p + 1) : s + k]:  # a word counts once within a passage's length
                    total += weight(w)
            best = max(best, total / len(bag))
        return best + m.bias

    for t in [*texts[:25], None, "", "...", "one", " ".join(texts[:12]), "Grumblya " * 40]:
        assert m.margins([t])[0] == pytest.approx(margin(t), abs=1e-5)
        assert m.scores([t])[0] == pytest.approx(1 / (1 + math.exp(-(m.slope * margin(t) + m.shift))), abs=1e-5)


def test_repeated_rows_score_alike(spark):
    texts, labels = toxic_corpus(120, 5)
    df = spark.createDataFrame([(k % 100, texts[k % 100]) for k in range(150)] + [(500, None), (501, "word " * 100_000)], "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([(k, labels[k]) for k in range(100)], "doc_id long, toxic int")
    model = toxicity.train(df, known, "toxic")
    got = toxicity.score(df, model).collect()
    assert len(got) == 152 and len({(r.doc_id, r.score) for r in got}) == 102


def test_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "c"), (3, None), (None, "x")] + [(7, f"copy {k}") for k in range(500)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (7, 0), (7, 0), (8, 0), (None, 1), (9, None), (10, 5)], "doc_id long, y int")
    texts, known, share = labelled.labelled_sample(docs, labels, "y", per_class=10)
    assert sorted(zip(texts, known, strict=True)) == [("", 1), ("", 1), ("c", 0), ("copy 0", 0)] and share == pytest.approx(3 / 7)
    texts, known, _ = labelled.labelled_sample(docs, labels, "y", per_class=1)
    assert len(texts) <= 2


# ---------------------------------------------------------------- language


def plain_grams(text):
    c = " " + (text or "").lower() + " "
    c = "".join(x if x.isalpha() else " " for x in c)
    out = Counter(x for x in c if x != " ")
    out.update(c[k : k + 2] for k in range(len(c) - 1) if c[k : k + 2] != "  ")
    out.update(c[k : k + 3] for k in range(len(c) - 2) if c[k + 1] != " ")
    return out


def code(g):
    n = 0
    for x in g:
        n = n << 21 | ord(x)
    return n


def plain_profile(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


@pytest.fixture(scope="module")
def speech(spark):
    rng = random.Random(4)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
    kinds = {"aa": ("the", "ing", "wh"), "bb": ("sch", "ung", "ö"), "cc": ("ción", "os", "ñ")}
    rows = [(x, make(p, rng.randint(1, 30)), 1, "s") for x, p in kinds.items() for _ in range(25)] + [(None, "the", 1, "s"), ("aa", None, 1, "s"), ("dd", "", 1, "s"), rows_of_ties()]
    return rows, spark.createDataFrame(rows, "lang string, text string, rank int, code string").repartition(4)


def rows_of_ties():
    return ("bb", "ab ba ab ba zq qz", 1, "s")


@pytest.mark.parametrize("size", [400, 12])
def test_profiles_and_distances_by_counting(spark, speech, size):
    rows, df = speech
    want = {}
    for lang in ("aa", "bb", "cc"):
        counts = Counter()
        for x, t, *_ in rows:
            if x == lang and t is not None:
                counts.update(plain_grams(t))
        want[lang] = plain_profile(counts, size)
    got = {}
    for r in sorted(language.profiles(df, size=size).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.lang, []).append(r.code)
    assert got == {x: [code(g) for g in p] for x, p in want.items()}
    model = language.train(df, size=size)
    for text in ["the ing", "sch ung ö", "ción", "x", "", None, "12", "the sch " * 4000, "aé" * 9000]:
        mine = plain_profile(plain_grams(text), size)
        if not mine:
            assert model.predict(text) == ("und", 0.0)
            continue
        away = {x: sum(abs(p.index(g) - k) if g in p else size for k, g in enumerate(mine)) for x, p in want.items()}
        best = min(sorted(away), key=away.get)
        assert model.predict(text) == (best, pytest.approx(1 - away[best] / (size * len(mine))))


def test_identify_on_odd_tables(spark, speech):
    rows, df = speech
    model = language.train(df)
    assert language.identify(df.limit(0), model).count() == 0
    clash = df.withColumn("lang_pred", F.lit("x"))
    with pytest.raises(ValueError, match="lang_pred"):
        language.identify(clash, model)
    out = language.identify(clash, model, lang_out=fresh(clash, "lang_pred"), score_out=fresh(clash, "score"))
    assert out.columns == [*clash.columns, "_lang_pred", "score"] and out.count() == len(rows)
    nothing = language.train(df.limit(0))
    assert {(r.lang_pred, r.score) for r in language.identify(df, nothing).collect()} == {("und", 0.0)}


# ---------------------------------------------------------------- quality


def prose(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        t = " ".join(rng.choice(("river", "house", "of", "green", "walks", "under", "Over", "12")) for _ in range(rng.randint(5, 40)))
        noisy = k % 3 == 0
        texts.append(t.upper().replace(" ", "!! ") if noisy and rng.random() < 0.9 else t + ".")
        labels.append(int(not noisy))
    return texts, labels


def test_quality_margin_and_the_hinge_optimum():
    texts, labels = prose(120, 1)
    m = quality.fit(texts, labels, rounds=400)
    rows = [m.features(t) for t in texts]
    # Log-count ratios of the indicators.
    on = {k: Counter() for k in (0, 1)}
    for r, k in zip(rows, labels, strict=True):
        on[k].update(r.tolist())
    buckets = m.features.buckets
    total = {k: sum(on[k].values()) + buckets for k in (0, 1)}
    ratio = lambda j: math.log((on[1][j] + 1) / total[1]) - math.log((on[0][j] + 1) / total[0])
    for t, r in [*list(zip(texts, rows, strict=True))[:15], (None, m.features(None)), ("", m.features("")), ("river " * 5000, m.features("river " * 5000))]:
        x = [ratio(j) for j in r.tolist()]
        length = math.sqrt(sum(v * v for v in x)) or 1.0
        margin = sum(v / length * float(m.weights[j]) for v, j in zip(x, r.tolist(), strict=True)) + m.bias
        assert m.margin(t) == pytest.approx(margin, abs=1e-4)
        assert m.scores([t])[0] == pytest.approx(1 / (1 + math.exp(-(m.slope * margin + m.shift))), abs=1e-4)
    # No small step from the fit lowers the hinge loss.
    values = [np.array([ratio(j) for j in r.tolist()]) for r in rows]
    values = [v / np.sqrt(v @ v) for v in values]
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    loss = lambda w, b: 0.5 * (w @ w + b * b) + sum(c * max(0.0, 1 - k * (w[r] @ v + b)) for c, k, r, v in zip(cost, y, rows, values, strict=True))
    w, b = quality._descend(rows, values, y, buckets, 1.0, 2000, 7)
    best, rng = loss(w, b), np.random.default_rng(2)
    used = np.unique(np.concatenate(rows))
    for _ in range(200):
        step = np.zeros(buckets)
        step[used] = rng.normal(size=len(used)) * rng.choice([1e-3, 1e-2, 0.1])
        assert loss(w + step, b + float(rng.normal()) * 0.01) > best - 1e-3


def test_quality_on_odd_tables(spark):
    texts, labels = prose(90, 2)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(0, texts[0], "x", 1), (200, None, "x", 1), (201, "", "x", 1), (None, "river", "x", 1)], "doc_id long, text string, quality string, score int").repartition(3)
    model = quality.train(df, spark.createDataFrame([(k, x) for k, x in enumerate(labels)], "doc_id long, quality int"))
    out = toxicity.score(df, model, out_col=fresh(df, "score")).collect()
    assert len(out) == 94 and all(0 <= r["_score"] <= 1 for r in out) and len({r["_score"] for r in out if r.doc_id == 0}) == 1
    assert len({r["_score"] for r in out if r.doc_id in (200, 201)}) == 1
    assert toxicity.score(df.limit(0), model, out_col="p").count() == 0


# ---------------------------------------------------------------- the pipeline


def write(spark, root, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string").repartition(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{root}/benchmark.parquet")


def test_pipeline_on_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "nu", "re")) for _ in range(rng.randint(1, 3)))
    long = " ".join(word() for _ in range(300))
    leak = " ".join(word() for _ in range(12))
    texts = {1: None, 2: "", 3: None, 4: " ", 5: long, 6: long, 7: long + " tail", 8: "short one", 9: "short one", 10: f"before {leak} after", 11: "x" * 50_000, 12: "éß ñ 你好\n\t12", 13: " ".join(word() for _ in range(200_000))}
    docs = [(i, t, None, "s", None, None, None) for i, t in texts.items()] + [(8, "short one", None, "s", 1, 0.5, "clash"), (8, "short one", None, "s", 1, 0.5, "clash")]
    write(spark, tmp_path, docs, [(1, 1, 0), (5, None, 0), (None, 1, 0)], [(1, leak), (2, None), (None, "short one")])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    # Null and empty are equal texts: the largest id of them stays; of the long ones one of the near copies.
    want = {3: None, 4: " ", 9: "short one", 11: texts[11], 12: texts[12], 13: texts[13]}
    found = {r.doc_id: r.decoded_sha256 for r in got}
    assert len(got) == len(found) and {i: found[i] for i in want} == {i: sha(t) for i, t in want.items()}
    assert set(found) - set(want) <= {6, 7} and len(set(found) - set(want)) == 1 and 10 not in found


def test_pipeline_of_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "decoded_sha256"] and out.count() == 0
