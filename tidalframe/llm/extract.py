"""Main text of web pages: boosted trees over DOM nodes, decoded as a tree.

Each block element and each leaf (a run of inline content) is scored from its
own text, its subtree, its siblings, its parent, its depth, its place and what
its tag and attribute words (and those above it) say: learnt log-odds of main
text. Three classes: no main text in the subtree, only main text, both. Decoding
takes the most likely labelling of a page's tree in which everything below a
node of one of the first two classes has that class, so no leaf is kept below a
dropped element and none is dropped below a kept one.

The trees are fitted on the driver on ``layouts``: texts of at most
``sample_pages`` pages of the table, set into ``n_layouts`` pages of known main
text. Nothing is learnt from addresses. Every page is then extracted whole.

Output: blocks of main text in page order, joined by one newline; references
decoded; white space (what ``str.split`` splits at, ``<br>`` too) inside a block
is one space, none at its ends.

Cases: null, empty and textless pages give an empty text; broken markup is read
as ``dom`` says; repeated rows give equal texts; an empty table gives no rows
(the trees are then fitted on filler words); other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import layouts
from .common import bytes_of, cut, held_batches
from .dom import Forest
from .trees import BoostedTrees

#: Pages that are read into one forest, and their bytes.
_PAGES, _BYTES = 256, 2 << 20
_FILLER = "It was a cold day in the north, and none of them had seen the road. They went on. Why? No one had asked them to stay here, so they left, one by one, before noon."
NONE, ONLY, BOTH = 0, 1, 2


def _subtree(forest_end: np.ndarray, x: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0.0], np.cumsum(x)])
    return before[forest_end] - before[:-1]


def features(forest: Forest, odds: dict[str, float]) -> np.ndarray:
    """A row of numbers for each node."""
    n = len(forest.parent)
    parent, end, depth = (np.array(getattr(forest, f), np.int64) for f in ("parent", "end", "depth"))
    leaf = np.array(forest.leaf, bool)
    up = np.where(parent < 0, np.arange(n), parent)
    own = {f: np.array(getattr(forest, f), float) for f in ("chars", "linked", "words", "marks", "commas", "capitals", "digits", "controls", "inline")}
    total = {f: _subtree(end, x) for f, x in own.items()}
    leaves, nodes = _subtree(end, leaf.astype(float)), _subtree(end, np.ones(n))
    long_leaves = _subtree(end, (own["chars"] >= 80).astype(float))
    short_links = _subtree(end, (leaf & (own["linked"] > 0.5 * own["chars"])).astype(float))
    root = np.repeat(np.concatenate([[0], forest.pages[:-1]]), np.diff([0, *forest.pages])).astype(np.int64)

    # What names say, of a node and of the elements above it.
    says, worst, most = np.zeros(n), np.zeros(n), np.zeros(n)
    for k, names in enumerate(forest.names):
        if names:
            x = [odds.get(w, 0.0) for w in names]
            says[k], worst[k], most[k] = sum(x), min(x), max(x)
    above, above_worst, above_most = np.zeros(n), np.zeros(n), np.zeros(n)
    by_depth = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[by_depth], np.arange(1, depth.max(initial=0) + 2))
    for a, z in zip(bounds, bounds[1:], strict=False):
        k = by_depth[a:z]
        p = up[k]
        above[k], above_worst[k], above_most[k] = above[p] + says[p], np.minimum(above_worst[p], worst[p]), np.maximum(above_most[p], most[p])

    # Siblings: nodes in order of parent, then of place.
    order = np.lexsort((np.arange(n), parent))
    starts = np.flatnonzero(np.concatenate([[True], parent[order][1:] != parent[order][:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, n))
    index, count, before, behind = np.zeros(n), np.zeros(n), np.full(n, -1), np.full(n, -1)
    index[order], count[order] = np.arange(n) - np.repeat(starts, size), np.repeat(size, size)
    together = parent[order][1:] == parent[order][:-1]
    before[order[1:][together]], behind[order[:-1][together]] = order[:-1][together], order[1:][together]
    tag = np.array([hash_of(t) for t in forest.tag], np.int64) if n else np.zeros(0, np.int64)
    _, alike = np.unique(parent * 1009 + tag % 1009, return_inverse=True)
    same = np.bincount(alike)[alike] if n else np.zeros(0)
    main_child = np.maximum.reduceat(total["chars"][order], starts) if n else np.zeros(0)
    largest = np.zeros(n)
    largest[order] = np.repeat(main_child, size)

    chars, words = np.maximum(total["chars"], 1), np.maximum(total["words"], 1)
    link = total["linked"] / chars
    text_before = np.cumsum(own["chars"]) - own["chars"]
    text_before = text_before - text_before[root]
    page = np.maximum(total["chars"][root], 1)
    at = lambda x, k: np.where(k >= 0, x[np.maximum(k, 0)], -1)
    kind = {k: np.array([t == k for t in forest.tag], float) for k in ("p", "li", "td", "h1")}
    columns = [
        leaf.astype(float), np.minimum(depth, 30), np.log1p(total["chars"]), total["words"] / np.maximum(leaves, 1), link, total["marks"] / words, total["commas"] / words, total["capitals"] / chars, total["digits"] / chars,
        total["controls"], total["inline"] / words, np.log1p(leaves), total["chars"] / nodes, long_leaves / np.maximum(leaves, 1), short_links / np.maximum(leaves, 1), total["chars"] / page, text_before / page, 1 - (text_before + total["chars"]) / page,
        says, worst, most, above, above_worst, above_most, says[up], link[up], np.log1p(total["chars"][up]), total["chars"][up] / page, np.minimum(count, 100), index / np.maximum(count, 1), same / np.maximum(count, 1), total["chars"] / np.maximum(largest, 1),
        np.log1p(np.maximum(at(total["chars"], before), 0)), at(link, before), at(says, before), np.log1p(np.maximum(at(total["chars"], behind), 0)), at(link, behind), at(says, behind), *kind.values(), long_leaves[up], own["chars"] / chars[up],
    ]
    return np.stack(columns, 1) if n else np.zeros((0, len(columns)))


_codes: dict[str, int] = {}


def hash_of(tag: str) -> int:
    """A number for a tag, the same in every process."""
    if len(_codes) > 10_000:
        _codes.clear()
    if tag not in _codes:
        _codes[tag] = sum(b * 31**k for k, b in enumerate(tag.encode()[:8])) % 1_000_003
    return _codes[tag]


def decode(forest: Forest, log_p: np.ndarray) -> np.ndarray:
    """The most likely class of each node among labellings without contradiction between a node and those below it.

    Elements without text take part in nothing; ties go to the smaller class.
    """
    n = len(forest.parent)
    parent, end, depth = (np.array(getattr(forest, f), np.int64) for f in ("parent", "end", "depth"))
    leaf = np.array(forest.leaf, bool)
    real = _subtree(end, leaf.astype(float)) > 0
    log_p = np.where(real[:, None], log_p, 0.0)
    log_p[leaf, BOTH] = -1e9
    log_p[parent < 0, :] = 0.0  # the document itself may be anything
    best = np.stack([_subtree(end, log_p[:, NONE]), _subtree(end, log_p[:, ONLY]), log_p[:, BOTH]], 1)
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    levels = [order[a:z] for a, z in zip(bounds, bounds[1:], strict=False)]
    for k in reversed(levels[1:]):
        np.add.at(best[:, BOTH], parent[k], best[k].max(1))
    out = np.zeros(n, np.int64)
    for k in levels:
        own = best[k].argmax(1)
        above = np.where(parent[k] < 0, BOTH, out[np.maximum(parent[k], 0)])
        out[k] = np.where(above == BOTH, own, above)
    return out


class Extractor:
    """Log-odds of tag and attribute words, and the trees."""

    def __init__(self, odds: dict[str, float], trees: BoostedTrees):
        self.odds, self.trees = odds, trees

    def texts(self, pages: list[str]) -> list[str]:
        forest = Forest()
        for page in pages:
            forest.read(page)
        state = decode(forest, self.trees.log_proba(features(forest, self.odds)))
        out, at = [], 0
        for stop in forest.pages:
            out.append("\n".join(forest.text[k] for k in range(at, stop) if state[k] == ONLY and k in forest.text))
            at = stop
        return out


def _labelled(pages: Iterable[str]) -> tuple[Forest, np.ndarray]:
    """Pages of ``layouts`` and each node's class; -1 for elements without text."""
    forest = Forest()
    for page in pages:
        forest.read(page)
    n = len(forest.parent)
    end, leaf, main = np.array(forest.end, np.int64), np.array(forest.leaf, float), np.zeros(n)
    for k, text in forest.text.items():
        if layouts.MARK in text:
            main[k] = 1
            forest.text[k] = text = text.replace(layouts.MARK, "")
            forest.chars[k] -= 1
            forest.names[k] = tuple(w.replace(layouts.MARK, "") for w in forest.names[k])
    of_main, of_all = _subtree(end, main), _subtree(end, leaf)
    return forest, np.where(of_all == 0, -1, np.where(of_main == 0, NONE, np.where(of_main == of_all, ONLY, BOTH)))


def fit(pieces: list[str], *, n_layouts: int = 1600, seed: int = 7) -> Extractor:
    """Word odds from half of the layouts, trees from the other half."""
    made = layouts.pages(pieces or [_FILLER], n_layouts, seed)
    forest, label = _labelled(made[::2])
    seen, counts = Counter(), [Counter(), Counter()]
    for names, y in zip(forest.names, label.tolist(), strict=True):
        seen.update(names)
        if y in (NONE, ONLY):
            counts[y].update(names)
    prior = math.log((sum(label == ONLY) + 1) / (sum(label == NONE) + 1))
    odds = {w: math.log((counts[ONLY][w] + 0.5) / (counts[NONE][w] + 0.5)) - prior for w, n in seen.items() if n >= 5}
    forest, label = _labelled(made[1::2])
    known = (label >= 0) & (np.array(forest.parent) >= 0)
    return Extractor(odds, BoostedTrees.fit(features(forest, odds)[known], label[known], 3))


def train(pages: DataFrame, *, html_col: str = "html", id_col: str = "page_id", sample_pages: int = 200, most_bytes: int = 1 << 16, n_layouts: int = 1600) -> Extractor:
    """Fit on texts of at most ``sample_pages`` pages of ``most_bytes`` or fewer, those of least identifier hash."""
    small = pages.where(F.octet_length(html_col).between(1, most_bytes)).orderBy(F.xxhash64(F.col(id_col).cast("string")), html_col).limit(sample_pages)
    forest = Forest()
    for page in small.select(html_col).toArrow().column(0).to_pylist():
        forest.read(page)
    return fit([t for k, t in sorted(forest.text.items()) if forest.linked[k] == 0], n_layouts=n_layouts)


def extract(pages: DataFrame, model: Extractor, *, html_col: str = "html", id_col: str = "page_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, the columns ``keep`` (text as it is), ``main_text`` and ``n_chars``, its code points; written once to the shared folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str] = []
            todo = iter(bytes_of(b.column(b.num_columns - 1)))
            while group := list(_up_to(todo)):
                texts.extend(model.texts(group))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([*b.columns[:-1], pa.array(texts, pa.string()), sizes], ["id", *keep, "main_text", "n_chars"])

    read = pages.select(F.col(id_col).alias("id"), *keep, F.col(html_col).alias("html"))
    schema = T.StructType([*read.schema.fields[:-1], T.StructField("main_text", T.StringType()), T.StructField("n_chars", T.LongType())])
    with held_batches(pages.sparkSession):
        return cut(read.mapInArrow(run, schema), "main-text")


def _up_to(texts: Iterator[bytes]) -> Iterator[str]:
    """The next pages, up to a bound of pages and bytes."""
    size = 0
    for t in islice(texts, _PAGES):
        size += len(t)
        yield t.decode("utf-8", "replace")
        if size > _BYTES:
            return
