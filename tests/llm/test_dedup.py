from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidalframe.llm import exact_dedup, line_dedup, ngram_join, repeats

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def test_exact(docs, rows, empty):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_duplicates(docs, fan_in=2).collect()
    assert len(got) == len(rows)
    for r in got:
        (group,) = [g for t, g in groups.items() if hashlib.sha256(t.encode()).digest() == bytes(r.digest)]
        assert r.group_size == len(group) and r.keep_id == max((i for i in group if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    least = {bytes(r.digest): r.keep_id for r in exact_dedup.exact_duplicates(docs, keep="min").collect()}
    assert all(least[hashlib.sha256(t.encode()).digest()] == min((i for i in g if i is not None), default=None) for t, g in groups.items())
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(t or "" for _, t in {(r.doc_id, r.text) for r in left.collect()}) == Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


@pytest.mark.parametrize(("block", "least"), [(64 << 20, 1), (200, 3)])
def test_lines(docs, rows, empty, block, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= least)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and seen[key(x)] >= 3)]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = line_dedup.line_report(docs, min_docs=3, min_chars=least, block_bytes=block, shard_keys=2).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == want
    assert any(k[2] for k in want)
    assert line_dedup.line_report(empty).count() == 0


def test_dropping_lines_keeps_columns(docs, rows):
    out = line_dedup.drop_common_lines(docs, min_docs=3)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert sum(r.text is None for r in out.collect()) == sum(t is None for _, t in rows)


def test_shard_is_minimal_and_perfect():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 500, 5000):
        h = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
        seeds, fps, counts = line_dedup.build_shard(h[:, 0], h[:, 1], np.arange(n) + 1)
        assert len(fps) == n
        held = line_dedup.Shards(1, [(0, seeds.tobytes(), fps.tobytes(), counts.tobytes())])
        assert (held.counts_of(h) == np.arange(n) + 1).all()
        assert (held.counts_of(rng.integers(0, 1 << 63, (100, 2), dtype=np.uint64)) == 0).all()


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER)) if x]
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 3_000_000), (2, 70, 300)])
def test_jaccard(docs, rows, n, percent, block):
    got = ngram_join.jaccard_components(docs, n=n, percent=percent, block_grams=block).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, n, percent)


def test_jaccard_of_nothing(empty):
    assert ngram_join.jaccard_components(empty).count() == 0


def test_trie_links_against_pairs():
    rng = random.Random(3)
    for _ in range(40):
        base = rng.sample(range(1000), 30)
        sets = []
        for _ in range(rng.randint(2, 14)):
            s = set(base if rng.random() < 0.7 else rng.sample(range(1000), 20))
            for _ in range(rng.randint(0, 6)):
                s ^= {rng.choice(base), rng.randrange(1000)}
            if s and s not in sets:
                sets.append(s)
        arrays = [np.unique(np.array(sorted(s), np.int64)) for s in sets]
        percent = rng.choice([60, 80, 90])
        want = ngram_join.Forest(len(sets))
        for a in range(len(sets)):
            for b in range(a):
                i = len(sets[a] & sets[b])
                if 100 * i >= percent * len(sets[a] | sets[b]):
                    want.join(a, b)
        got = ngram_join.Forest(len(sets))
        for a, b in ngram_join.links(arrays, None, percent):
            got.join(a, b)
        assert [got.find(k) for k in range(len(sets))] == [want.find(k) for k in range(len(sets))]


def brute_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = Counter()
    for (i, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        out[i, len(b), bytes(c for c, g in zip(b, gone, strict=False) if not g)] += 1
    return out


@pytest.mark.parametrize(("length", "shard"), [(100, 4 << 20), (40, 300)])
def test_repeats(docs, rows, length, shard):
    got = repeats.remove_repeats(docs, length=length, gram=16, shard_bytes=shard).collect()
    assert Counter((r.id, r.n_bytes, bytes(r.kept)) for r in got) == brute_repeats(rows, length)


def test_repeats_of_nothing(empty):
    assert repeats.remove_repeats(empty).count() == 0


def test_interval_expansion_against_counting():
    rng = random.Random(1)
    for _ in range(200):
        length, letters = rng.choice([3, 5, 8, 20]), rng.choice([b"ab", b"abc\x00", bytes(range(256))])
        base = bytes(rng.choice(letters) for _ in range(60))
        ranges = [base[a : a + rng.randint(0, 50)] if rng.random() < 0.6 else bytes(rng.choice(letters) for _ in range(rng.randint(0, 50))) for a in (rng.randint(0, 40) for _ in range(rng.randint(1, 8)))]
        seen = Counter(x[k : k + length] for x in ranges for k in range(len(x) - length + 1))
        want = [[k for k in range(len(x) - length + 1) if seen[x[k : k + length]] > 1] for x in ranges]
        assert [g.tolist() for g in repeats.repeats_among(ranges, length)] == want


def test_strings_that_polynomial_hashes_confuse(spark):
    """Thue-Morse bytes and their complement: equal under any polynomial modulo a power of two, different in every byte."""
    rng = random.Random(4)
    turn = [bin(k).count("1") % 2 for k in range(1024)]
    head, tail = ("".join(rng.choice("klmnop") for _ in range(200)) for _ in range(2))
    texts = [head + "".join("ab"[t] for t in turn) + tail, head + "".join("ba"[t] for t in turn) + tail]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length, shard in ((1200, 4 << 20), (1200, 1), (150, 4 << 20)):
        got = {r.id: bytes(r.kept) for r in repeats.remove_repeats(df, length=length, gram=64, shard_bytes=shard).collect()}
        assert got == {i: kept for i, _, kept in brute_repeats(list(enumerate(texts)), length)}
    assert got != dict(enumerate(t.encode() for t in texts))  # the equal ends go
