"""Ward's tree against a cubic search, silhouettes against loops, components against a dense decomposition."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest

from tidalframe.operators import clusters as C
from tidalframe.operators import text_components as T


def brute_ward(x):
    """Merge the pair whose union adds least to the sum of squares, over all pairs at each step."""
    spread = lambda m: ((x[m] - x[m].mean(0)) ** 2).sum()
    sets, out = {k: [k] for k in range(len(x))}, []
    for step in range(len(x) - 1):
        a, b = min(combinations(sorted(sets), 2), key=lambda p: spread(sets[p[0]] + sets[p[1]]) - spread(sets[p[0]]) - spread(sets[p[1]]))
        grown = spread(sets[a] + sets[b]) - spread(sets[a]) - spread(sets[b])
        sets[len(x) + step] = sets.pop(a) + sets.pop(b)
        out.append((a, b, math.sqrt(2 * grown), len(sets[len(x) + step])))
    return np.array(out)


@pytest.mark.parametrize("n", [2, 3, 7, 25])
def test_ward_as_searching_all(n):
    for seed in range(6):
        x = np.random.default_rng((n, seed)).normal(size=(n, 3))
        np.testing.assert_allclose(C.ward(x), brute_ward(x), atol=1e-9)


def test_ward_of_ties_and_few():
    assert C.ward(np.zeros((0, 2))).shape == C.ward(np.zeros((1, 2))).shape == (0, 4)
    m = C.ward(np.zeros((5, 2)))
    assert len(m) == 4 and not m[:, 2].any() and m[-1, 3] == 5
    grid = np.array([[i, j] for i in range(4) for j in range(4)], float)
    assert C.ward(grid)[-1, 3] == 16 and (np.diff(C.ward(grid)[:, 2]) >= -1e-9).all()


def test_cutting_a_tree():
    x = np.array([[0.0], [10], [0.1], [10.2], [30]])
    assert C.cut_tree(C.ward(x), 5, 3).tolist() == [0, 1, 0, 1, 2] and C.cut_tree(C.ward(x), 5, 1).tolist() == [0] * 5 and C.cut_tree(C.ward(x), 5, 5).tolist() == [0, 1, 2, 3, 4]


def plain_silhouette(x, label):
    out = []
    for i in range(len(x)):
        d = lambda js: np.mean([np.linalg.norm(x[i] - x[j]) for j in js])  # noqa: E731, B023
        own = [j for j in range(len(x)) if label[j] == label[i] and j != i]
        if not own:
            out.append(0.0)
            continue
        a, b = d(own), min(d([j for j in range(len(x)) if label[j] == g]) for g in set(label) - {label[i]})
        out.append((b - a) / max(a, b))
    return out


def test_silhouettes_and_scan(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(5, 4)) + c for c in (0, 9, 40)] + [[[90.0] * 4]])
    label = [0] * 5 + [1] * 5 + [2] * 5 + [3]
    np.testing.assert_allclose(C.silhouettes(x, np.array(label)), plain_silhouette(x, label))
    rows = [("s", 2000 + k, v.tolist(), label[k]) for k, v in enumerate(x)] + [("two", 1, [0.0] * 4, 0), ("two", 2, [1.0] * 4, 1)]
    df = spark.createDataFrame(rows, "key string, name int, shape array<double>, label int").repartition(3)
    got = {r.name: r.silhouette for r in C.labelled_silhouettes(df, "key", "name", "label", "shape").where("key = 's'").collect()}
    np.testing.assert_allclose([got[2000 + k] for k in range(len(x))], plain_silhouette(x, label))
    found = sorted(C.scan(df, "key", "name", "shape").collect(), key=lambda r: r.name)
    z = (x - x.mean(0)) / x.std(0)
    want = {k: np.mean(plain_silhouette(z, C.k_means(z, k).tolist())) for k in range(2, 7)}
    k = max(want, key=want.get)
    assert {r.key for r in found} == {"s"} and {r.k for r in found} == {k} and found[0].score == pytest.approx(want[k])
    np.testing.assert_allclose([r.silhouette for r in found], plain_silhouette(z, [r.cluster for r in found]))
    assert found[-1].unusual == max(r.unusual for r in found) == 15 / 16 and found[-1].nearest in {str(2000 + j) for j in range(10, 15)}
    tree = C.trees(df, "key", "name", "shape").where("key = 's'").orderBy("step").collect()
    np.testing.assert_allclose([(r.left, r.right, r.height, r.size) for r in tree], brute_ward(z), atol=1e-9)


def test_k_means_finds_the_best_split():
    x = np.random.default_rng(8).normal(size=(9, 2))
    cost = lambda label: sum(((x[label == g] - x[label == g].mean(0)) ** 2).sum() for g in set(label.tolist()))
    best = min(cost(np.array([(m >> i) & 1 for i in range(9)])) for m in range(1, 2**8))
    assert cost(C.k_means(x, 2)) == pytest.approx(best)


def test_shapes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 1, 2.0), ("a", 3, 6.0), ("b", 2, 0.0), ("c", 2, None)], "k string, m int, v double")
    assert {r.k: r["shape"] for r in C.shapes(df, ["k"], F.col("m"), "v", 3).collect()} == {"a": [0.25, 0.0, 0.75]}


# ---------------------------------------------------------------- texts

TEXTS = ["The rates rise, the rates fall", "rates RISE again", None, "", "fall fall fall", "a b c", "bank of rates; bank rates", "rise and fall and rise"]


def test_terms_and_weights(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)
    got = {}
    for r in T.tf_idf(df, ["id"], "text", features=6, stop=("the", "and", "of")).collect():
        got.setdefault(r.id, {})[r.term] = r.weight
    import re

    docs = {}
    for i, t in enumerate(TEXTS):
        if t is not None:
            w = [x for x in re.findall(r"\w\w+", t.lower()) if x not in ("the", "and", "of")]
            docs[i] = w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    total = {}
    for d in docs.values():
        for t in d:
            total[t] = total.get(t, 0) + 1
    top = sorted(total, key=lambda t: (-total[t], t))[:6]
    for i, d in docs.items():
        w = {t: d.count(t) * (math.log((1 + len(docs)) / (1 + sum(t in e for e in docs.values()))) + 1) for t in top if t in d}
        size = math.sqrt(sum(v * v for v in w.values()))
        assert got.get(i, {}) == pytest.approx({t: v / size for t, v in w.items()})


def test_weights_deal_texts_once(spark):
    """Terms are never sent by key, and a null in a key is a key like others, as in the SQL."""
    df = spark.createDataFrame([(1, None, "rates rise fast"), (1, 2, "rates fall"), (2, 2, "fast rates")], "a int, b int, text string")
    out = T.tf_idf(df, ["a", "b"], "text", features=4)
    got = {}
    for r in out.collect():
        got[r.a, r.b] = got.get((r.a, r.b), 0) + r.weight**2
    assert got == {(1, None): pytest.approx(1), (1, 2): pytest.approx(1), (2, 2): pytest.approx(1)}
    by_key = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(a#" in x]
    assert by_key and all("term#" not in x and "REPARTITION_BY_COL" in x for x in by_key)


def test_components_as_dense(spark):
    rng = np.random.default_rng(2)
    dense = (rng.normal(size=(300, 4)) * [5, 3, 2, 1]) @ rng.normal(size=(4, 40)) + 0.05 * rng.normal(size=(300, 40)) + 0.4
    dense[rng.random(dense.shape) < 0.0] = 0
    dense[:, 7] = 0
    rows = [(k, [j for j in range(40) if v[j]], [float(v[j]) for j in range(40) if v[j]]) for k, v in enumerate(dense)]
    df = spark.createDataFrame(rows, "id int, places array<int>, weights array<double>").repartition(5)
    m = T.components(df, 40, 3)
    centered = dense - dense.mean(0)
    values, vectors = np.linalg.eigh(centered.T @ centered / 299)
    np.testing.assert_allclose(m["values"], values[::-1][:3], rtol=1e-8)
    overlap = np.linalg.svd(m["loadings"].T @ vectors[:, ::-1][:, :3])[1]
    np.testing.assert_allclose(overlap, 1, atol=1e-8)
    got = {r.id: r.scores for r in T.scores(df, m).collect()}
    np.testing.assert_allclose([got[k] for k in range(300)], centered @ m["loadings"], atol=1e-8)
