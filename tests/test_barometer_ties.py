"""R18 equals its SQL where means lie half-way between two reported values."""

from __future__ import annotations

import duckdb

import __spark_entry__ as entry


def test_history_rounds_ties_as_sql(spark, tmp_path):
    rows = []
    for k in range(240):
        # Third observations of 64 to 512 words: a mean over 2 + 3n with n = 2 or 10 ends in a ninth decimal of 5.
        for turn in range(12):
            n, held = 2 ** (6 + (k + turn) % 4), (k * 7 + turn * 3) % 5
            rows.append((k, turn, " ".join(["les"] * held + ["of"] * (turn % 2) + ["word"] * (n - held - turn % 2))))
    spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    cols = ["conv_id", "turn", "x", "mean", "sd", "low", "high", "alert"]
    got = {tuple(r) for r in entry.queries()["R18_barometer_history"](spark, str(tmp_path)).select(*cols).collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = set(db.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()['R18_barometer_history']})").fetchall())
    assert len(got) == len(rows) and len(got - want) == 0, sorted(got - want)[:3] + sorted(want - got)[:3] + [len(got - want)]
