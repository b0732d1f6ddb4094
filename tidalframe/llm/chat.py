"""Conversations from quoting messages.

Messages quote each other in lines that begin with ``>`` (deeper quotes with
more of them). 1. Quote levels are parsed: a passage is a run of lines of one
level. 2. Pieces of passages (all of one, its paragraphs, its lines) are
normalised (case, blanks, signs at the ends of words) and hashed. 3. Pieces of
quoted runs join those of the unquoted text of other messages: the message
that holds most words of a run of level 1, and half of them at least, is the
one replied to. 4. Each message follows the one it replies to, or, without a
quote that is found, the message before it in its own conversation; the
resulting trees are written out in reply order, without quotes.

The join is by hash. In a run's own conversation all earlier messages are
compared, and of those that hold equally much the latest wins (one that holds
the whole run in one piece first), also over other conversations. In other
conversations all messages count, and of those that hold equally much the one
with the longest piece, then the earliest, wins. Of several runs of a message,
those found in its conversation come first, then the latest message. A part of
a line is no piece, and lines wrapped anew are found only as whole paragraphs
or passages.

Defined results: a null text is an empty message; a message of quotes only
keeps its place with empty text; a null or unknown role is "unknown"; rows
that repeat conversation and turn are ordered by role and text; a null
conversation is one of its own; an empty table gives an empty result. A
conversation becomes one row, so it must fit into a task.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

_MARK = re.compile(r"^\s{0,3}((?:>[ \t]?)+)")
_WORD = re.compile(r"\w+")


def quote_lines(text: str | None) -> list[tuple[int, str]]:
    """Each line's quote level and its text without the marks."""
    out = []
    for line in (text or "").split("\n"):
        m = _MARK.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def passages(text: str | None) -> list[tuple[int, str]]:
    """Runs of lines of one level, blank lines at their ends left out."""
    runs: list[tuple[int, list[str]]] = []
    for level, line in quote_lines(text):
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(line)
    return [(level, body) for level, lines in runs if (body := "\n".join(lines).strip())]


def normalised(passage: str) -> str:
    return " ".join(_WORD.findall(passage.lower()))


def key_of(passage: str) -> int | None:
    words = normalised(passage)
    return int.from_bytes(xxhash.xxh3_64_digest(words.encode()), "big", signed=True) if words else None


def unquoted(text: str | None) -> str:
    return "\n".join(line for level, line in quote_lines(text) if level == 0).strip()


def held_keys(text: str | None) -> list[int]:
    """Hashes by which a message can be quoted: its whole own text, that text's passages between quotes, and the paragraphs and lines of them."""
    own = unquoted(text)
    parts = [own, *re.split(r"\n\s*\n", own), *own.split("\n")]
    for level, p in passages(text):
        if level == 0:
            parts += [p, *re.split(r"\n\s*\n", p)]
    return list(dict.fromkeys(k for p in parts if (k := key_of(p)) is not None))


def pieces(run: str) -> list[tuple[int, int, int]]:
    """``key, lo, hi`` of a quoted run, its paragraphs and its lines, where lo:hi are the words covered; the run itself comes first."""
    lines, spans, at, start = run.split("\n"), [], 0, 0
    paragraph: list[str] = []
    for line in [*lines, ""]:
        if line.strip():
            n = len(_WORD.findall(line.lower()))
            spans.append((line, at, at + n))
            paragraph.append(line)
            at += n
        else:
            spans.append(("\n".join(paragraph), start, at))
            paragraph, start = [], at
    return list(dict.fromkeys((k, lo, hi) for p, lo, hi in [(run, 0, at), *spans] if (k := key_of(p)) is not None))


def covered(spans: Iterable[tuple[int, int]]) -> int:
    """Words in the union of spans."""
    total = end = 0
    for lo, hi in sorted(spans):
        total += max(0, hi - max(lo, end))
        end = max(end, hi)
    return total


def best_earlier(row: int, run: list[tuple[int, int, int]], rows_of: dict[int, list[int]]) -> tuple[int, int | None]:
    """Most words of ``run`` that one message before ``row`` holds, and the latest such message.

    ``rows_of`` has the sorted holders of each key. Messages that hold none
    but the commonest piece are not looked at one by one: the latest holder of
    that piece is no worse.
    """
    earlier = [(n, k, lo, hi) for k, lo, hi in run if (n := bisect_left(rows_of.get(k, ()), row))]
    whole = [rows_of[k][n - 1] for n, k, lo, hi in earlier if (lo, hi) == run[0][1:]]
    if whole:
        return run[0][2], max(whole)
    common = max(earlier, default=(0, 0))[1]
    seen = {rows_of[k][n - 1] for n, k, _, _ in earlier if k == common}
    for n, k, _, _ in earlier:
        if k != common:
            seen.update(rows_of[k][:n])
    held: dict[int, list[tuple[int, int]]] = {m: [] for m in seen}
    for n, k, lo, hi in earlier:
        for m in seen if k == common else rows_of[k][:n]:
            if k != common or rows_of[k][min(bisect_left(rows_of[k], m), n - 1)] == m:
                held[m].append((lo, hi))
    return max(((covered(x), m) for m, x in held.items()), default=(0, None))


def rare_keys(run: list[tuple[int, int, int]], holders: dict[int, tuple[int, int]]) -> list[int]:
    """Keys of ``run`` of which a message must hold one to hold half of its words; ``holders``: classes and conversations of a key.

    The rarest first: what is left behind them covers less than half. If two
    conversations hold the whole run in one piece, one of them wins, so only
    that piece is looked for.
    """
    whole = run[0][0]
    if holders.get(whole, (0, 0))[1] >= 2:
        return [whole]
    order = sorted((x for x in run if x[0] in holders), key=lambda x: (holders[x[0]][0], x))
    for k in range(len(order) + 1):
        if 2 * covered((lo, hi) for _, lo, hi in order[k:]) < run[0][2]:
            return list(dict.fromkeys(x[0] for x in order[:k]))
    return []


def best_elsewhere(runs: DataFrame, holds: DataFrame) -> DataFrame:
    """``pieces, two``: for each distinct run the best holders of two conversations, better first, as ``less, longest, first``.

    Best: most words (``-less``, at least half), then the longest piece, then the
    earliest. Exact: messages that hold the same of all keys are one class, which
    its earliest messages of two conversations stand for; classes are brought to
    a run by its rare keys (``rare_keys``) and then compared with all its pieces.
    """
    kind = runs.schema["pieces"].dataType.simpleString()
    runs = cut(runs.withColumn("run_id", F.monotonically_increasing_id()), "runs")
    held = holds.groupBy("conv", "row", "turn").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    firsts = held.groupBy("keys", "conv").agg(F.min(F.struct("turn", "row")).alias("f")).select("keys", F.struct("f.turn", "conv", "f.row").alias("first"))
    firsts = firsts.withColumn("k", F.row_number().over(Window.partitionBy("keys").orderBy("first"))).where("k <= 2")
    classes = cut(firsts.groupBy("keys").agg(F.array_sort(F.collect_list("first")).alias("firsts")).withColumn("class_id", F.monotonically_increasing_id()), "classes")
    by_key = classes.select("class_id", F.size("firsts").alias("convs"), F.explode("keys").alias("key"))
    # Of conversations only whether there are two matters, and two classes of one each may share it.
    convs = classes.select(F.explode("keys").alias("key"), F.explode("firsts").alias("f")).groupBy("key").agg((F.min("f.conv").eqNullSafe(F.max("f.conv")) & (F.count("f.conv").isin(0, F.count("*")))).alias("one"))
    counts = by_key.groupBy("key").agg(F.count("*").alias("n")).join(convs, "key").select("key", "n", F.when(F.col("one"), 1).otherwise(2).alias("convs"))
    known = runs.select("run_id", F.explode("pieces").alias("p")).select("run_id", F.col("p.key").alias("key")).distinct().join(counts, "key")
    known = known.groupBy("run_id").agg(F.collect_list(F.struct("key", "n", "convs")).alias("known")).join(runs, "run_id")

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(r, k) for r, pieces_, known_ in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True) for k in rare_keys([(p["key"], p["lo"], p["hi"]) for p in pieces_], {x["key"]: (x["n"], x["convs"]) for x in known_})]
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["run_id", "key"])

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, longest = [], []
            for pieces_, keys in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                spans = [(p["lo"], p["hi"]) for p in pieces_ if p["key"] in set(keys)]
                words.append(covered(spans))
                longest.append(max((hi - lo for lo, hi in spans), default=0))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(words, pa.int32()), pa.array(longest, pa.int32())], ["run_id", "class_id", "words", "longest"])

    chosen = known.select("run_id", "pieces", "known").mapInArrow(choose, "run_id long, key long")
    pairs = chosen.join(by_key.select("key", "class_id"), "key").select("run_id", "class_id").distinct()
    weighed = pairs.join(runs, "run_id").join(classes.select("class_id", "keys"), "class_id").select("run_id", "class_id", "pieces", "keys").mapInArrow(weigh, "run_id long, class_id long, words int, longest int")
    each = weighed.join(classes.select("class_id", "firsts"), "class_id").select("run_id", (-F.col("words")).alias("less"), (-F.col("longest")).alias("longest"), F.explode("firsts").alias("first"))
    each = each.groupBy("run_id", "first.conv").agg(F.min(F.struct("less", "longest", "first")).alias("best"))
    two = each.withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy("best"))).where("k <= 2").groupBy("run_id").agg(F.array_sort(F.collect_list("best")).alias("two"))
    return two.join(runs, "run_id").select(F.col("pieces").cast(kind).alias("pieces"), "two")


def link_messages(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per message: ``conv, turn, role, body, row, parent, quoted``.

    ``row`` numbers a conversation's messages, ``parent`` is (conv, row) of
    the message replied to or null, ``quoted`` whether a quote named it.
    """
    narrow = messages.select(
        F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )

    piece = pa.struct([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, held, quotes = [], [], []
            for text in b.column(3).to_pylist():
                bodies.append(unquoted(text))
                held.append(held_keys(text))
                runs = dict.fromkeys(tuple(pieces(p)) for level, p in passages(text) if level == 1)
                quotes.append([[dict(zip(("key", "lo", "hi"), x, strict=True)) for x in run] for run in runs if run])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bodies, pa.string()), pa.array(held, pa.list_(pa.int64())), pa.array(quotes, pa.list_(pa.list_(piece)))], names=[*b.schema.names, "body", "held", "quotes"])

    kind = "array<struct<key:long,lo:int,hi:int>>"
    schema = T.StructType([*narrow.schema.fields, *T.StructType.fromDDL(f"body string, held array<long>, quotes array<{kind}>").fields])
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    # Parsed and numbered once: four branches read it.
    rows = cut(narrow.mapInArrow(parse, schema).withColumn("row", F.row_number().over(order)).drop("text"), "messages")
    quoting = rows.where(F.size("quotes") > 0).select("conv", "row", "quotes")
    asked = quoting.select(F.explode(F.flatten("quotes")).alias("p")).select(F.col("p.key").alias("key")).distinct()
    # Only what somebody quotes is looked at.
    holds = rows.select("conv", "row", "turn", F.explode("held").alias("key")).join(asked, "key", "left_semi")
    asks = quoting.groupBy("conv").agg(F.collect_list(F.struct("row", "quotes")).alias("asks"))
    near = holds.groupBy(F.col("conv").alias("at")).agg(F.collect_list(F.struct("key", "row")).alias("holds"))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, asks, holds in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows_of = defaultdict(list)
                for h in holds or ():
                    rows_of[h["key"]].append(h["row"])
                for r in rows_of.values():
                    r.sort()
                out = [(a["row"], run, *best_earlier(a["row"], [(p["key"], p["lo"], p["hi"]) for p in run], rows_of)) for a in asks for run in a["quotes"]]
                at, runs, words, up = zip(*out, strict=True)
                for k in range(0, len(out), 1000):
                    part = slice(k, k + 1000)
                    n = len(at[part])
                    yield pa.record_batch([pa.array([conv] * n, pa.string()), pa.array(at[part], pa.int32()), pa.array(range(k, k + n), pa.int32()), pa.array(runs[part], pa.list_(piece)), pa.array(words[part], pa.int32()), pa.array(up[part], pa.int32())], ["conv", "row", "run", "pieces", "words", "up"])

    found = asks.join(near, F.col("conv").eqNullSafe(F.col("at")), "left").select("conv", "asks", "holds").mapInArrow(search, f"conv string, row int, run int, pieces {kind}, words int, up int")
    total = F.col("pieces")[0]["hi"]
    # What the conversation does not hold in full is looked for in others.
    found = cut(found, "runs-at-home")
    away = found.where(F.col("words") < total)
    elsewhere = best_elsewhere(away.select("pieces").distinct(), holds)
    away = away.select("conv", "row", "run", "pieces").join(elsewhere, "pieces")
    # Two holders of different conversations are known: one of them is in another than the asker's.
    other = F.when(F.col("two")[0]["first"]["conv"].eqNullSafe(F.col("conv")), F.get("two", F.lit(1))).otherwise(F.col("two")[0])
    away = away.withColumn("best", other).where("best is not null")
    away = away.select(F.col("conv").alias("at"), F.col("row").alias("r"), F.col("run").alias("k"), (-F.col("best.less")).alias("n"), "best.first")
    found = found.join(away, F.col("conv").eqNullSafe(F.col("at")) & (F.col("row") == F.col("r")) & (F.col("run") == F.col("k")), "left")
    here = F.coalesce(F.col("words") >= F.col("n"), F.lit(True)) & F.col("up").isNotNull()
    parent = F.when(here, F.struct("conv", F.col("up").alias("row"))).when(F.col("n").isNotNull(), F.struct(F.col("first.conv").alias("conv"), F.col("first.row").alias("row")))
    best = found.where(2 * F.greatest("words", "n") >= total).select("conv", "row", parent.alias("parent"), (~here).alias("away")).where("parent is not null")
    best = best.groupBy("conv", "row").agg(F.min(F.struct("away", (-F.col("parent.row")).alias("late"), "parent")).alias("best"))
    best = best.select(F.col("conv").alias("at"), F.col("row").alias("r"), F.col("best.parent").alias("named"))
    linked = rows.join(best, F.col("conv").eqNullSafe(F.col("at")) & (F.col("row") == F.col("r")), "left")
    previous = F.when(F.col("row") > 1, F.struct(F.col("conv"), (F.col("row") - 1).alias("row")))
    return linked.select("conv", "turn", "role", "body", "row", F.coalesce("named", previous).alias("parent"), F.col("named").isNotNull().alias("quoted"))


def conversations(linked: DataFrame) -> DataFrame:
    """``conv, n_messages, n_quoted, messages``: each conversation in reply order.

    Depth first over replies, answers to one message by their row. A message
    that answers another conversation begins a branch of its own, whose
    ``parent`` names that conversation's message.
    """
    message = "array<struct<role:string,content:string,row:int,parent_conv:string,parent_row:int>>"
    rows = linked.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("row", "role", "body", "parent"))).alias("rows"), F.count("*").alias("n_messages"), F.sum(F.col("quoted").cast("long")).alias("n_quoted"))

    def arrange(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string()), ("row", pa.int32()), ("parent_conv", pa.string()), ("parent_row", pa.int32())]))
        for b in batches:
            out = []
            for conv, rows in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                below: dict[int | None, list[dict]] = {}
                for r in rows:
                    p = r["parent"]
                    below.setdefault(p["row"] if p and p["conv"] == conv else None, []).append(r)
                done, stack = [], below.get(None, [])[::-1]
                while stack:
                    r = stack.pop()
                    p = r["parent"] or {"conv": None, "row": None}
                    done.append({"role": r["role"], "content": r["body"], "row": r["row"], "parent_conv": p["conv"], "parent_row": p["row"]})
                    stack += below.get(r["row"], [])[::-1]
                out.append(done)
            yield pa.record_batch([*b.columns[:3], pa.array(out, kind)], ["conv", "n_messages", "n_quoted", "messages"])

    return rows.select("conv", "n_messages", "n_quoted", "rows").mapInArrow(arrange, f"conv string, n_messages long, n_quoted long, messages {message}")

