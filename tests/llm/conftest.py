from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, kept string, score double, h long, n int, node string, id string, row long, chunk long, spans string"


def base_texts() -> list[str | None]:
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("ta", "ve", "xi", "zo", "bu", "Da")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = make(300)
    shared = make(60)
    out: list[str | None] = [None, "", " ", "\n\n", "a", "one two", "éß ñ 你好 word", long, long, long.replace("ka", "KA", 1), long + " tail end", shared + " " + make(50), make(40) + " " + shared, "x" * 900, "x" * 900]
    for k in range(20):
        t = make(rng.randint(5, 120)).split()
        if k % 3 == 0:
            t[len(t) // 2 : len(t) // 2] = ["\nCommon Line \n"]
        out.append(" ".join(t))
    out += [make(200) + "\n" + make(30) + "\n\tcommon line\n" for _ in range(12)]
    near = make(150).split()
    for k in range(6):
        t = list(near)
        t[k * 20] = f"edit{k}"
        out.append(" ".join(t))
    return out


@pytest.fixture(scope="session")
def texts():
    return base_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 2 else None, "clash", 0.5, 1, 2, "n", "i", 3, 4, "s") for k, t in enumerate(texts)]
    rows.append(rows[7])  # a repeated row
    rows.append((None, "null id " + (texts[7] or ""), None, None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
