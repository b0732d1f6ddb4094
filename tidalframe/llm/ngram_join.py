"""N-gram Jaccard self-join of documents, and its connected components.

A document's set holds its distinct word n-grams, hashed. Two documents link
when ``100 * |A and B| >= percent * |A or B|``.

1. Documents of equal sets become one node. From here on, only nodes count, so
   copies (however many) cost nothing more.
2. Part sums. A set of ``n`` n-grams differs from one it links with in at most
   ``n (100 - percent) / percent`` of them. Cut the hash space into so many
   parts that a set fills ``need`` more of them than that: linked sets are then
   the same, and have the same sum of hashes, in ``need`` parts at least. Part
   sums, a fraction of a number for each n-gram, are all that every document
   sends. A node with fewer than ``need`` shared sums links with nothing.
3. Prefix filter. Of its shared sums a node keeps all but its ``need - 1`` most
   frequent ones; linked nodes still share one. So what many documents have in
   common (a passage, a line) brings none of them together. Nodes that keep the
   same sum form a group; groups of the same nodes count once.
4. Prefix-tree join. The sets of a group, rarest n-grams first, go into a trie
   whose edges are runs of n-grams. A set walks the trie from the root: all
   sets below an edge share the overlap counted so far, and a subtree is left
   when the overlap, plus what can still follow in the set and below, cannot
   reach the bound, or when all sets below are already in the same component.
   First, the tries of each group's members are walked by its first member
   only. The links so found make components, and groups within one component
   (most groups of near copies, whatever their size) are done. In the others,
   every member walks. Groups that overlap are joined as one family, each set
   once, unless the family has more than ``block_grams`` n-grams; then they
   stay apart, and a group that is larger by itself is cut into slices that are
   joined pair by pair, each pair in a task of its own.
5. Links (a spanning forest of them) give the components.

Every step is lossless: no group is capped. 64-bit hashes stand for n-grams
and 128-bit hashes for sets.

Defined results: null or empty text, or no word, is an empty set and linked
with nothing; fewer than ``n`` words are one n-gram; repeated rows share a
component; a null identifier never names a component unless all are null; an
empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BitFilter, WordHash, bytes_of, cut, mix, shingles, signed, tokens_of

#: Size classes grow by this factor; a document belongs to those its partners may be in.
GROWTH = 1.5
#: N-grams of an edge that are walked before the bound is looked at again.
STEP = 32
_SALT = np.uint64(0x5BD1E9955BD1E995)


def node_of(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def size_class(n: int) -> int:
    return max(0, math.floor(math.log(max(n, 1)) / math.log(GROWTH) + 1e-9))


def differences(n: int, percent: int) -> int:
    """By how many n-grams a set of ``n`` and any set linked with it can differ."""
    return (100 - percent) * n // percent


def parts_of(c: int, percent: int) -> int:
    """Parts for class ``c``: so many that a set fills more than it can have differences."""
    return math.ceil(1.12 * differences(math.ceil(GROWTH ** (c + 1) + 1e-6), percent)) + (3 if percent < 100 else 1)


def part_sums(grams: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """Sums of the hashes in each part, for the set's class and those of larger partners.

    For each class: the sums, and how many of them a linked set has at least.
    Each n-gram in which two sets differ changes one part, so of the parts that
    a set fills all but its possible differences are the same in the other. A
    set that fills too few (its hashes crowd) also sends its empty parts, so two
    such sets meet as well.
    """
    n, most, out = len(grams), differences(len(grams), percent), []
    for c in range(size_class(n), size_class(n * 100 // percent) + 1):
        m = parts_of(c, percent)
        part = ((mix(grams) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams[order] ^ _SALT), dtype=np.uint64)])
        at = np.searchsorted(part[order], np.arange(m + 1))
        sums = mix((total[at[1:]] - total[at[:-1]]) ^ mix(np.arange(m, dtype=np.uint64) + np.uint64(c << 40)))
        full = at[1:] > at[:-1]
        need = int(full.sum()) - most
        out.append((sums[full], need) if need > 0 else (sums, 1))
    return out


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """Least overlap of linked sets of ``a`` and ``b`` n-grams."""
    return -(-percent * (a + b) // (100 + percent))


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


class Trie:
    """Sets in one order, as edges that are runs of n-grams (a compressed trie).

    The edges lie in preorder in flat arrays; ``last`` is the set that ends at
    an edge (or -1), ``under`` the range of sets below it.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
        rows = [sets[k] for k in self.order]
        self.sizes = np.asarray([len(r) for r in rows], np.int64)
        n = len(rows)
        shared = [0] * n  # with the row before
        for k in range(1, n):
            a, b = rows[k - 1], rows[k]
            m = min(len(a), len(b))
            away = np.flatnonzero(a[:m] != b[:m])
            shared[k] = int(away[0]) if len(away) else m
        start, stop, lo, hi, row, children, roots, stack = [], [], [], [], [], [], [], []

        def edge(k: int, a: int, b: int, first: int) -> int:
            row.append(k), start.append(a), stop.append(b), lo.append(first), hi.append(n), children.append([])
            return len(row) - 1

        for k in range(n):
            cutoff, below = shared[k] if k else 0, None
            while stack and start[stack[-1]] >= cutoff:
                below = stack.pop()
                hi[below] = k
            if stack and stop[stack[-1]] > cutoff:  # split the edge: its top stays, the rest hangs below
                top = stack[-1]
                rest = edge(row[top], cutoff, stop[top], lo[top])
                hi[rest], children[rest], children[top], stop[top] = k, children[top], [rest], cutoff
            new = edge(k, cutoff, len(rows[k]), k)
            (children[stack[-1]] if stack else roots).append(new)
            stack.append(new)
        for e in stack:
            hi[e] = n
        self.row, self.start, self.stop, self.lo, self.hi = (np.asarray(x, np.int64) for x in (row, start, stop, lo, hi))
        self.roots = np.asarray(roots, np.int64)
        self.child_at = np.concatenate([[0], np.cumsum([len(c) for c in children])]).astype(np.int64)
        self.child = np.asarray([x for c in children for x in c], np.int64)
        self.flat = np.concatenate(rows) if n else np.zeros(0, np.int64)
        self.row_at = np.concatenate([[0], np.cumsum(self.sizes)])
        # Sizes below an edge, for the length bounds: least and most over its range of sets.
        self.least = np.asarray([self.sizes[a:b].min() for a, b in zip(lo, hi, strict=True)], np.int64)
        self.most = np.asarray([self.sizes[a:b].max() for a, b in zip(lo, hi, strict=True)], np.int64)

    def overlaps(self, query: np.ndarray, held: np.ndarray, percent: int, skip=None) -> tuple[np.ndarray, np.ndarray]:
        """Sets (numbers in ``order``) that link with ``query``, with their overlap.

        ``held[g]``: whether the query has n-gram ``g``. ``skip(lo, hi)``: no set
        of that range matters. Long edges are walked ``STEP`` n-grams at a time.
        """
        q = len(query)
        edges, over = self.roots, np.zeros(len(self.roots), np.int64)
        done, found, count = self.start[edges], [], []
        while len(edges):
            length = np.minimum(self.stop[edges] - done, STEP)
            ends = np.cumsum(length)
            at = np.repeat(self.row_at[self.row[edges]] + done - (ends - length), length) + np.arange(ends[-1])
            grams = self.flat[at]
            total = np.concatenate([[0], np.cumsum(held[grams])])
            over = over + total[ends] - total[ends - length]
            done = done + length
            through = done == self.stop[edges]
            # Sets that end on this very edge come first in its range.
            for f in np.flatnonzero(through & self._ends(edges)):
                k = self.lo[edges[f]]
                while k < self.hi[edges[f]] and self.sizes[k] == done[f]:
                    if over[f] >= needed(q, self.sizes[k], percent):
                        found.append(k), count.append(over[f])
                    k += 1
            seen = np.searchsorted(query, grams[ends - 1], side="right")
            least, most = self.least[edges], self.most[edges]
            reach = over + np.minimum(q - seen, most - done)
            go = (reach >= needed(q, np.maximum(least, -(-percent * q // 100)), percent)) & (most * 100 >= percent * q) & (least * percent <= 100 * q)
            if skip is not None and go.any():
                at = np.flatnonzero(go)
                go[at] = [not skip(a, b) for a, b in zip(self.lo[edges[at]], self.hi[edges[at]], strict=True)]
            along, below = go & ~through, np.flatnonzero(go & through)
            n = self.child_at[edges[below] + 1] - self.child_at[edges[below]]
            e = np.cumsum(n)
            children = self.child[np.repeat(self.child_at[edges[below]] - (e - n), n) + np.arange(e[-1] if len(e) else 0)]
            over = np.concatenate([over[along], np.repeat(over[below], n)])
            done = np.concatenate([done[along], self.start[children]])
            edges = np.concatenate([edges[along], children])
        return np.asarray(found, np.int64), np.asarray(count, np.int64)

    def _ends(self, edges: np.ndarray) -> np.ndarray:
        return self.sizes[self.lo[edges]] == self.stop[edges]


def links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, labels: list | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``left``, or between ``left`` and ``right``.

    In the second form, right sets have the numbers after the left ones. Sets
    of equal ``labels`` are known to be in one component. The n-grams are
    numbered by their frequency here, rarest first, ties by hash.
    """
    sets = left + (right or [])
    grams, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(grams))
    sizes = np.asarray([len(s) for s in sets])
    ends = np.cumsum(sizes)
    coded = [np.sort(rank[number[e - n : e]]) for e, n in zip(ends, sizes, strict=True)]
    # Linked sets share one of their first n-grams: of the rest, so many as they need at least are too few.
    first = sizes - -(-percent * sizes // 100) + 1
    heads = np.concatenate([c[:n] for c, n in zip(coded, first, strict=True)])
    among = [np.bincount(h, minlength=len(grams)) for h in np.split(heads, [first[: len(left)].sum()])]
    meet = among[0] > 1 if right is None else (among[0] > 0) & (among[1] > 0)
    open_ = np.logical_or.reduceat(meet[heads], np.cumsum(first) - first)
    stored = np.flatnonzero(open_[: len(left)])
    asking = stored if right is None else len(left) + np.flatnonzero(open_[len(left) :])
    if not len(stored) or not len(asking):
        return []
    trie, forest, out = Trie([coded[k] for k in stored]), Forest(len(sets)), []
    place = [int(stored[k]) for k in trie.order]
    named: dict = {}
    for k, label in enumerate(labels or []):
        forest.join(named.setdefault(label, k), k)
    held = np.zeros(len(grams), bool)
    for q in asking.tolist():

        def known(lo: int, hi: int) -> bool:
            return hi - lo <= 64 and all(forest.find(place[k]) == forest.find(q) for k in range(lo, hi))

        held[coded[q]] = True
        for k in trie.overlaps(coded[q], held, percent, known)[0]:
            if forest.join(place[k], q):
                out.append((place[k], q))
        held[coded[q]] = False
    return out


def components(edges: DataFrame, label: str) -> DataFrame:
    """``node, root`` for the nodes of the undirected ``edges(a, b)``: the least node reachable.

    Alternating large and small stars: in each round a node sends its larger,
    then its smaller neighbours the least node it knows. Ends when a round
    changes nothing; the number of rounds grows with the logarithm of the
    longest path. Every round's edges are written to the shared folder.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), label)
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small.withColumnRenamed("a", "n"), F.col("a") == F.col("n"))
        moved = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        edges = cut(moved, label)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def trie_links(sets: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """``a, b``: spanning links of each task of ``places(block, one, two, side, label, key)``.

    A task is one value of (block, one, two). If ``one = two``, all its sets are
    stored in a trie and walk it; otherwise those of side 0 are stored, those of
    side 1 walk. Tasks are streamed in order: one is in memory at a time.
    """

    def join(rows: list[tuple], both: bool) -> list[tuple[bytes, bytes]]:
        nodes = {}
        for side, label, node, grams in rows:  # repeated rows bring a set again
            nodes.setdefault(node, (side, label, np.frombuffer(grams, np.uint64)))
        order = sorted(nodes, key=lambda k: nodes[k][0])
        sets, labels = [nodes[k][2] for k in order], [nodes[k][1] for k in order]
        split = sum(nodes[k][0] == 0 for k in order)
        if len(set(labels)) < 2 or not (both or 0 < split < len(sets)):
            return []
        found = links(sets, None, percent, labels) if both else links(sets[:split], sets[split:], percent, labels)
        return [(order[a], order[b]) for a, b in found]

    def tasks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            found = join(rows, now[1] == now[2]) if len(rows) > 1 else []
            return pa.record_batch([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            for *task, side, label, node, grams in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if task != now:
                    if now is not None:
                        yield done()
                    now, rows = task, []
                rows.append((side, label, node, grams))
        if now is not None:
            yield done()

    task = ["block", "one", "two"]
    dealt = sets.join(places, "key").select(*task, "side", "label", "node", "grams")
    return dealt.repartition(*task).sortWithinPartitions(*task).mapInArrow(tasks, "a binary, b binary")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 3, percent: int = 90, block_grams: int = 3_000_000, log2_bits: int | None = None
) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, node``.

    ``node`` names the set: equal in documents of equal sets, null if empty.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    narrow = narrow.select("id", "text", F.xxhash64("id", "text").alias("row"))

    def sets_of(texts: pa.Array, hashed: WordHash) -> list[np.ndarray]:
        return [np.unique(shingles(hashed(tokens_of(t)), n)) for t in bytes_of(texts)]

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, none = WordHash(), np.zeros(0, np.int64)
        for b in batches:
            sets = sets_of(b.column(1), hashed)
            nodes = [node_of(s) if len(s) else None for s in sets]
            keys = [None if x is None else int.from_bytes(x[:8], "big", signed=True) for x in nodes]
            sums = [part_sums(s, percent) if len(s) else [] for s in sets]
            flat = lists([np.concatenate([none, *(x.view(np.int64) for x, _ in s)]) for s in sums])
            sizes = lists([np.asarray([len(x) for x, _ in s], np.int64) for s in sums])
            needs = lists([np.asarray([need for _, need in s], np.int64) for s in sums])
            yield pa.record_batch(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.int64()), flat, sizes, needs],
                ["id", "row", "n", "node", "key", "sums", "sizes", "needs"],
            )

    schema = T.StructType([narrow.schema["id"], *T.StructType.fromDDL("row long, n long, node binary, key long, sums array<long>, sizes array<long>, needs array<long>").fields])
    table = cut(narrow.mapInArrow(describe, schema), "sets")

    # Part sums that two nodes have. A short mark, another for each sum, tells nodes apart here.
    sums = table.where("key is not null").select("key", F.explode("sums").alias("s")).select("s", F.hash("s", "key").alias("mark"))
    shared = sums.groupBy("s").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a != b").select("s")
    held = spark.sparkContext.broadcast(BitFilter.of(shared, "s", log2_bits))

    def hits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            keys, sizes, needs = b.column(0).to_numpy(), b.column(2), b.column(3)
            lists = b.column(1)
            flat = lists.values.to_numpy().view(np.uint64)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            per = np.diff(sizes.offsets.to_numpy())
            size, need = (x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in (sizes, needs))
            of = np.repeat(np.arange(len(size)), size)  # each sum's class of each document
            at = bits.has(flat)
            at &= (np.bincount(of, weights=at, minlength=len(size)) >= need)[of]
            yield pa.record_batch([pa.array(np.repeat(keys, per)[of[at]]), pa.array(size[of[at]]), pa.array(need[of[at]]), signed(flat[at])], ["key", "class", "need", "s"])

    met = table.where("key is not null").select("key", "sums", "sizes", "needs").mapInArrow(hits, "key long, class long, need long, s long").distinct()
    met = cut(met, "shared-sums")
    often = cut(met.groupBy("s").agg(F.count("*").alias("nodes")).where("nodes > 1"), "often")
    own = Window.partitionBy("key", "class", "need")
    ranked = met.join(often, "s").select("*", F.count("*").over(own).alias("all"), F.row_number().over(own.orderBy("nodes", "s")).alias("k"))
    kept = cut(ranked.where("k <= all - need + 1").select("s", "key").distinct(), "kept-sums")
    groups = kept.groupBy("s").agg(F.min("key").alias("lead"), F.max("key").alias("last"), F.count("*").alias("nodes"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "key")).alias("y"))
    once = cut(groups.where("lead != last").groupBy("lead", "last", "nodes", "x", "y").agg(F.min("s").alias("block")).select("block", "lead"), "groups")
    members = cut(kept.withColumnRenamed("s", "block").join(once, "block"), "members")

    # The sets of these nodes, each read from one of its documents.
    alone = members.select("key").distinct()
    nodes = cut(table.where("node is not null").groupBy("node", "key", "n").agg(F.min("row").alias("row")).join(alone, "key"), "nodes")
    chosen = spark.sparkContext.broadcast(BitFilter.of(nodes, "row", log2_bits))

    def carry(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, bits = WordHash(), chosen.value
        for b in batches:
            texts = b.column(1).filter(pa.array(bits.has(b.column(0).to_numpy().view(np.uint64))))
            found = {node_of(s): s.tobytes() for s in sets_of(texts, hashed) if len(s)}
            keys = [int.from_bytes(x[:8], "big", signed=True) for x in found]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["key", "node", "grams"])

    sets = cut(narrow.select("row", "text").mapInArrow(carry, "key long, node binary, grams binary"), "node-sets")

    # Each group's first member against the others, in slices; what it does not join is left to the group.
    size = nodes.select("key", "n")
    stars = members.where("key != lead").select(F.col("lead").alias("block"), "key").distinct().join(size, "key")
    slices = stars.groupBy("block").agg(F.ceil(F.sum("n") / F.lit(max(1, block_grams // 100))).cast("int").alias("slices"))
    below = stars.join(slices, "block").select("block", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int").alias("one"), F.lit(0).alias("side"), "key")
    above = slices.select("block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("one"), F.lit(1).alias("side"), F.col("block").alias("key"))
    places = below.unionByName(above).select("block", "one", F.lit(-1).alias("two"), "side", F.col("key").alias("label"), "key")
    found = cut(trie_links(sets, places, percent), "first-links")
    roots = cut(components(found, "first-roots"), "roots")

    label = nodes.join(roots, "node", "left").select("key", "n", F.xxhash64(F.coalesce("root", "node")).alias("label"))
    named = cut(members.select("block", "key").join(label, "key"), "named-members")
    open_ = named.groupBy("block").agg(F.min("label").alias("least"), F.max("label").alias("b")).where("least != b").select("block", "least")
    named = cut(named.join(cut(open_, "open-groups"), "block"), "open-members")
    # Groups with members in common are one family if it is small enough, or stay apart.
    edges = named.where("label != least").select(F.col("label").alias("a"), F.col("least").alias("b")).distinct()
    family = components(edges, "families").withColumnRenamed("node", "label")
    whole = named.select("key", "n", "label").distinct().join(family, "label")
    small = F.col("grams") <= block_grams
    sizes = cut(whole.groupBy("root").agg(F.sum("n").alias("grams")), "family-sizes")
    together = whole.join(sizes.where(small), "root").select(F.col("root").alias("block"), F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("side"), "label", "key")
    apart = named.join(family, "label").join(sizes.where(~small), "root").select("block", "key", "n", "label")
    slices = apart.groupBy("block").agg(F.ceil(F.sum("n") / block_grams).cast("int").alias("slices"))
    dealt = apart.join(slices, "block").withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))
    dealt = dealt.select("block", "key", "label", "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("with"))
    apart = dealt.select("block", F.least("slice", "with").alias("one"), F.greatest("slice", "with").alias("two"), (F.col("slice") > F.col("with")).cast("int").alias("side"), "label", "key")
    places = together.unionByName(apart)
    more = trie_links(sets, places, percent)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "links")

    least = table.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    least = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = least.groupBy("root").agg(F.min("least").alias("component"))
    named = least.select("node", "root").join(named, "root").select("node", "component")
    return table.select("id", "n", "node").join(named, "node", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"), "node"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, percent: int = 80, **params) -> DataFrame:
    """``docs`` with one document of each component, that of least identifier; columns unchanged.

    Documents with an empty set stay. Rows that share the kept identifier stay
    or fall together.
    """
    gone = jaccard_components(docs, id_col, text_col, n=n, percent=percent, **params)
    gone = gone.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
