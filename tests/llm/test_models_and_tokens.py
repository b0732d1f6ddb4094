from __future__ import annotations

import base64
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidalframe.llm import bpe, chat, decontaminate, language, quality, toxicity


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_word_encoding_against_library(ranks, encoding):
    rng = random.Random(0)
    for _ in range(300):
        w = "".join(rng.choice("abcdeéñ你 '0") for _ in range(rng.randint(1, 40))).encode()
        got = bpe.encode_word(w, ranks)
        assert b"".join(encoding.decode_single_token_bytes(i) for i in got) == w
        text = w.decode()
        parts = [i for p in __import__("regex").findall(public_tokenizers.PATTERN, text) for i in bpe.encode_word(p.encode(), ranks)]
        assert parts == encoding.encode_ordinary(text)
    assert bpe.encode_word(b"ab" * 20000, ranks) == encoding.encode_ordinary("ab" * 20000)


@pytest.mark.parametrize("chunk", [3_000_000, 50])
def test_documents_against_library(docs, rows, empty, ranks, encoding, chunk):
    out = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, chunk_tokens=chunk, buckets=7), ranks).collect()
    want = Counter((i, tuple(encoding.encode_ordinary(t or ""))) for i, t in rows)
    assert Counter((r.id, tuple(r.token_ids)) for r in out) == want
    assert Counter((r.id, bytes(r.decoded)) for r in out) == Counter((i, (t or "").encode()) for i, t in rows)
    if chunk > 50:
        assert bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


def brute_windows(rows, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    cut = {}
    for item, t in items:
        w = words(t)
        if w and item is not None:
            cut.setdefault(str(item), set()).update(tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1)))
    out = Counter()
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, wins in cut.items():
            for win in wins:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit.update(range(k, k + len(win)))
                        found.add(item)
        out[i, len(w), len(hit), tuple(sorted(found))] += 1
    return out


def test_contamination(spark, docs, rows, texts, empty):
    w = texts[7].split()
    items = [(1, " ".join(w[10:35])), (2, "one TWO"), (3, "a"), (10, " ".join(w[100:112]) + " other words after it all the way"), (4, None), (5, "..."), (6, "never seen anywhere at all"), (None, "a"), (1, " ".join(w[200:215])), (7, " ".join(w[50:57]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, table).collect()
    hits = lambda r: sum(s["end"] - s["start"] for s in r.spans)
    want = brute_windows(rows, items, 10)
    assert Counter((r.id, r.n_words, hits(r), tuple(r["items"])) for r in got) == want
    left = decontaminate.drop_contaminated(docs, table)
    assert left.columns == docs.columns and left.count() == sum(n for k, n in want.items() if not k[2])
    assert decontaminate.contamination(empty, table).count() == 0
    assert decontaminate.contamination(docs, table.limit(0)).where(F.size("spans") > 0).count() == 0


def toxic_corpus(n: int, seed: int):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(("ka", "lo", "mi", "nu", "re", "so", "ta")) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    rng = random.Random(seed + 1)
    texts, labels = [], []
    for k in range(n):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(10, 150))]
        bad = k % 4 == 0
        if bad:
            for _ in range(2):
                t[rng.randrange(len(t))] = rng.choice(("grumbly", "wozzler")) + rng.choice("abcdefgh")
        texts.append(" ".join(t)), labels.append(int(bad))
    return texts, labels


def test_toxicity_on_held_out_spellings():
    texts, labels = toxic_corpus(600, 1)
    model = toxicity.fit(texts[:400], labels[:400], prior=0.25)
    s = model.scores(texts[400:])
    assert ((s >= 0.3) == (pytest.importorskip("numpy").array(labels[400:]) == 1)).mean() > 0.95
    clean = texts[401]
    assert model.scores([clean + " xgrumblyz wozzlerq"])[0] > model.scores([clean])[0]
    assert all(0 <= x <= 1 for x in model.scores([None, "", "  ", "a" * 20000]))


def test_models_without_classes():
    assert toxicity.fit([], []).scores(["a", None]).tolist() == [0.0, 0.0]
    assert toxicity.fit(["a"], [1]).scores(["a"]).tolist() == [1.0]
    assert quality.fit([], []).scores([None]).tolist() == [0.0]


def test_quality_held_out():
    rng = random.Random(2)
    texts, labels = [], []
    for k in range(400):
        t = [rng.choice(("river", "house", "of", "green", "walks", "under")) for _ in range(rng.randint(10, 80))]
        texts.append(" ".join(t).upper().replace(" ", "!! ") if k % 4 == 0 else " ".join(t) + ".")
        labels.append(int(k % 4 != 0))
    s = quality.fit(texts[:300], labels[:300]).scores(texts[300:])
    assert ((s >= 0.5).astype(int) == labels[300:]).mean() > 0.97
    assert all(0 <= x <= 1 for x in quality.fit(texts, labels).scores([None, "", "?"]))


def test_scores_keep_columns(spark, docs, rows, empty):
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(20)] + [(None, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels, "toxic")
    out = toxicity.score(docs, model, out_col="p")
    assert out.columns == [*docs.columns, "p"] and out.count() == len(rows) and out.where("p is null or p < 0 or p > 1").count() == 0
    with pytest.raises(ValueError, match="score"):
        toxicity.score(docs, model)
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0)), out_col="p").count() == 0
    assert quality.train(docs, labels, "quality").scores(["x"]).tolist() == [0.0]


def test_language(spark):
    rng = random.Random(4)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(40))
    kinds = {"aa": ("the", "ing", "wh", "tion"), "bb": ("sch", "ung", "ei", "ö"), "cc": ("ción", "os", "ñ", "que")}
    rows = [(x, make(p)) for x, p in kinds.items() for _ in range(30)] + [(None, "the"), ("aa", None), ("aa", "")]
    table = spark.createDataFrame(rows, "lang string, text string")
    model = language.train(table.limit(1000))
    test = [(x, make(p)) for x, p in kinds.items() for _ in range(20)]
    got = language.identify(spark.createDataFrame([*test, (None, None), (None, "12 ²³ !?"), (None, "")], "lang string, text string"), model).collect()
    assert sum(r.lang == r.lang_pred for r in got if r.lang) >= 58
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.lang is None)
    assert language.train(table.limit(0)).predict("the") == ("und", 0.0)


MAIL = [
    ("c1", 1, "ann", "Hello all.\n\nShall we meet on Monday?"),
    ("c1", 2, "bob", "> Shall we meet on monday\n\nYes, at ten."),
    ("c1", 3, "cid", "> Hello   all.\nHi Ann!"),
    ("c1", 4, "ann", "> > Shall we meet on Monday?\n>\n> Yes, at ten.\nFine."),
    ("c2", 1, "dan", "> Yes, at ten\nWho wrote this?"),
    ("c2", 2, None, None),
    ("c3", 1, "eve", "> words nobody wrote\nOdd."),
]


def test_quotes_and_reply_order(spark):
    table = spark.createDataFrame(MAIL, "conv_id string, turn int, role string, text string").withColumn("row", F.lit("clash"))
    linked = {(r.conv, r.row): r for r in chat.link_messages(table).collect()}
    assert linked["c1", 2].parent.row == 1 and linked["c1", 3].parent.row == 1 and linked["c1", 4].parent.row == 2
    assert (linked["c2", 1].parent.conv, linked["c2", 1].parent.row) == ("c1", 2) and linked["c2", 2].parent.row == 1
    assert linked["c3", 1].parent is None and not linked["c3", 1].quoted
    out = {r.conv: r for r in chat.conversations(chat.link_messages(table)).collect()}
    assert [m.content for m in out["c1"].messages] == ["Hello all.\n\nShall we meet on Monday?", "Yes, at ten.", "Fine.", "Hi Ann!"]
    assert [m.role for m in out["c2"].messages] == ["dan", "unknown"] and out["c2"].messages[1].content == ""
    assert chat.conversations(chat.link_messages(table.limit(0))).count() == 0
    assert chat.quote_lines("> > a\n>b\nc") == [(2, "a"), (1, "b"), (0, "c")]


def links(spark, rows):
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    return {(r.conv, r.row): (tuple(r.parent) if r.parent else None, r.quoted) for r in chat.link_messages(table).collect()}


def test_quotes_of_parts(spark):
    first = "One apple a day.\n\nTwo pears at night,\nthree plums at noon,\nfour figs at dawn.\n\nFive nuts."
    rows = [
        ("a", 1, "x", first), ("a", 2, "y", "Something else."),
        ("a", 3, "x", "> One apple a day.\n>\n> Two pears at night,\n> three plums at noon,\n> four figs at dawn.\n\nTwo paragraphs."),
        ("a", 4, "y", "> Two pears at night,\n> three plums at noon,\n\nTwo lines."),
        ("a", 5, "x", "> Something else.\nleft one\nleft two\n> One apple a day.\nright one\nright two"),
        ("a", 6, "y", "five nuts.\n"), ("a", 7, "x", "Filler."),
        ("a", 8, "y", "> left one\n> left two\nA passage between quotes, wrapped as it was."),
        ("a", 9, "x", "> right one right two\nA passage wrapped anew."),
        ("a", 10, "y", "> Two pears at night,\n> Five nuts.\nThe first holds more than the sixth."),
        ("a", 11, "x", "> Five nuts.\n> and many other words that nobody wrote\nLess than half."),
        ("b", 1, "z", "> three plums at noon,\n> four figs at dawn.\nFrom elsewhere."),
    ]
    got = links(spark, rows)
    want = {3: 1, 4: 1, 8: 5, 9: 5, 10: 1}
    assert {k: got["a", k] for k in want} == {k: (("a", v), True) for k, v in want.items()}
    assert got["a", 11] == (("a", 10), False) and got["b", 1] == (("a", 1), True)


def test_quotes_across_conversations_and_without_one(spark):
    rows = [
        ("a", 1, "x", "> shared words\nAsked before its own conversation holds them."), ("a", 2, "y", "shared words"),
        ("b", 7, "z", "shared words"), ("c", 9, "z", "shared words"), ("d", 3, "z", "> shared words\nFirst holder is in a."),
        (None, 1, "u", "no conversation"), (None, 2, "v", "filler"), (None, 3, "w", "> no conversation\nInside."), ("e", 1, "t", "> no conversation\nFrom outside."),
        (None, 4, "w", "> shared words\nTo another."),
    ]
    got = links(spark, rows)
    assert got["a", 1] == (("b", 1), True) and got["d", 1] == (("a", 2), True)
    assert got[None, 3] == ((None, 1), True) and got["e", 1] == ((None, 1), True) and got[None, 4] == (("a", 2), True)
    assert len(got) == len(rows)


def test_best_earlier_against_all_messages():
    rng = random.Random(8)
    for _ in range(300):
        run = chat.pieces("\n".join(rng.choice(["a b", "c", "d e f", "", "g"]) for _ in range(rng.randint(1, 6))).strip())
        if not run:
            continue
        held = {m: {k for k, _, _ in run if rng.random() < 0.4} for m in range(1, 9)}
        rows_of = {k: [m for m in held if k in held[m]] for k, _, _ in run}
        want = max(((chat.covered([(lo, hi) for k, lo, hi in run if k in held[m]]), m) for m in range(1, 6) if held[m]), default=(0, None))
        whole = [m for m in range(1, 6) if run[0][0] in held[m]]  # the run as it is comes before its scattered pieces
        assert chat.best_earlier(6, run, rows_of) == ((run[0][2], max(whole)) if whole else want)


def test_ranks_file(ranks):
    line = base64.b64encode(b"a").decode()
    assert line and ranks[b"a"] < 256 and len(ranks) == 50256
