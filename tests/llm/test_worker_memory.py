"""What a reused Python worker holds is bounded, whatever the size of a batch."""

from __future__ import annotations

import tracemalloc

import numpy as np

from tidalframe.llm.common import WordHash
from tidalframe.llm.toxicity import Model


def test_scores_split_some_texts_at_a_time():
    rng = np.random.default_rng(1)
    model = Model(rng.standard_normal(1 << 12).astype(np.float32), 0.25, 16)
    texts = [" ".join(f"w{k % 997}" for k in row) for row in rng.integers(0, 1 << 30, (4000, 200))]
    texts[7:7] = [None, "", "w1 " * 300_000]
    one_by_one = np.concatenate([model.margins([t]) for t in texts])
    texts[9] = "w1"
    one_by_one[9] = model.margins(["w1"])[0]
    tracemalloc.start()
    got = model.margins(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == one_by_one).all()
    assert peak < 20 << 20  # 800,000 words as strings take some 40 MB


def test_word_hashes_are_forgotten():
    hashed = WordHash()
    for k in range(0, 400_000, 1000):
        words = [b"%d" % w for w in range(k, k + 1000)]
        first = hashed(words)
    assert len(hashed.known) <= 101_000 and (WordHash()(words) == first).all()
