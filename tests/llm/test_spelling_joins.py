"""The words of a corpus are never broadcast, however small their compressed table."""

from __future__ import annotations

from tidalframe.llm import spelling


def test_words_are_joined_by_sorting(spark):
    rows = [("wordings", 40), ("wording", 3), ("wordinge", 1), ("another", 2)]
    out = spelling.spelling_forms(spark.createDataFrame(rows, "word string, n long"))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out.collect()}
    assert got == {"wordings": (None, "wordings", 40, 2, None), "wording": ("wordings", "wordings", 3, 2, 40), "wordinge": ("wordings", "wordings", 1, 2, 40), "another": (None, "another", 2, 0, None)}
    words = spark.createDataFrame([(k, w) for k, (w, _) in enumerate(rows)], "id long, word string")
    for df in (out, spelling.near_pairs(words)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
