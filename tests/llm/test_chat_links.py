"""Links of quoting messages against comparing every run with every message."""

from __future__ import annotations

import random

import pytest

from tidalframe.llm import chat


def link(spark, rows):
    table = spark.createDataFrame([(c, t, r, x, "clash", 1, 2) for c, t, r, x in rows], "conv_id string, turn int, role string, text string, body string, held int, quotes int").repartition(3)
    return sorted(((r.conv, r.turn, r.role, r.body, r.row, tuple(r.parent) if r.parent else None, r.quoted) for r in chat.link_messages(table).collect()), key=str)


def plain_links(rows):
    """Every run against every message: the rules of the module, without keys, classes or joins."""
    by_conv = {}
    for c, t, r, x in rows:
        by_conv.setdefault(c, []).append((t, r or "unknown", x or ""))
    messages = []
    for c, ms in by_conv.items():
        ms.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]))
        messages += [(c, t, r, x, k + 1) for k, (t, r, x) in enumerate(ms)]
    held = {(m[0], m[4]): set(chat.held_keys(m[3])) for m in messages}
    first = lambda m: (m[1] is not None, m[1] or 0, m[0] is not None, m[0] or "", m[4])
    out = []
    for c, t, r, x, row in messages:
        named = []
        for level, body in chat.passages(x):
            run = chat.pieces(body) if level == 1 else []
            if not run:
                continue
            total, best = run[0][2], None
            spans = lambda m, run=run: [(lo, hi) for k, lo, hi in run if k in held[m[0], m[4]]]
            home = [(run[0][0] in held[m[0], m[4]], chat.covered(spans(m)), m[4]) for m in messages if m[0] == c and m[4] < row and spans(m)]
            words, up = max(home)[1:] if home else (0, None)
            if words < total:
                away = [(-chat.covered(spans(m)), -max(hi - lo for lo, hi in spans(m)), first(m), m) for m in messages if m[0] != c and spans(m)]
                best = min(away, default=None, key=lambda a: a[:3])
            n = -best[0] if best else 0
            if 2 * max(words, n) < total:
                continue
            here = up is not None and words >= n
            parent = (c, up) if here else (best[3][0], best[3][4])
            named.append((not here, -parent[1], parent[0] is not None, parent[0] or "", parent))
        parent = min(named)[4] if named else None
        out.append((c, t, r, chat.unquoted(x), row, parent or ((c, row - 1) if row > 1 else None), bool(named)))
    return sorted(out, key=str)


def test_the_message_that_holds_all_is_found_behind_earlier_ones(spark):
    lines = ["apples are red today", "pears are green tonight", "plums are blue at noon"]
    rows = [(f"e{k}", k, "x", f"{lines[k // 2]}\nsomething else {k}") for k in range(6)]
    rows += [("whole", 50, "y", "\n".join(lines) + "\nand a fourth line"), ("asks", 99, "z", "".join(f"> {x}\n" for x in lines) + "Which of them?")]
    got = link(spark, rows)
    assert next(r for r in got if r[0] == "asks")[5:] == (("whole", 1), True)
    assert got == plain_links(rows)


@pytest.mark.parametrize("seed", range(6))
def test_links_as_comparing_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = ["yes", "no thanks", "see you at ten", "fine", "the red car is here", "Hello all", "what is the plan for the day", "ok"]
    rows = []
    for _ in range(120):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines.append(rng.choice(["", "", "> ", "> ", "> ", "> > "]) + rng.choice([*words, "", f"only once {rng.randrange(40)}"]))
        rows.append((rng.choice(["a", "b", "c", "d", "e", "f", "g", None]), rng.choice([None, *range(30)]), rng.choice(["ann", "bob", None]), rng.choice(["\n".join(lines)] * 9 + [None])))
    rows += [rows[3], rows[3], rows[40]]  # repeated rows
    assert link(spark, rows) == plain_links(rows)


def test_many_holders_of_common_lines(spark):
    """Lines that every message holds: classes stand for them, and the rare line decides."""
    rng, rows = random.Random(1), []
    for k in range(150):
        rows.append((f"c{k % 40}", k, "x", "\n".join(["good morning to all of you", "best regards from here"] + ([f"the figure is {k} units"] if k % 3 else []))))
    for k in range(0, 150, 10):
        rows.append((f"q{k}", 1000 + k, "y", f"> good morning to all of you\n> best regards from here\n> the figure is {rng.randrange(150)} units\nRight?"))
    rows.append(("long", 2000, "z", "> good morning to all of you\n" + "word " * 50_000))
    assert link(spark, rows) == plain_links(rows)
