"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition becomes one run: digests, identifiers and lengths,
sorted by digest and written to the shared folder. Runs meet in rounds, as in
a binomial tree with ``fan_in`` children a node: ``fan_in`` neighbouring runs
exchange their rows by digest and merge into one, which is dealt to as many
tasks as the session shuffles to, so no run is ever one task's; each digest keeps one row with the retained identifier and the
number of rows it stands for, so a digest that holds a third of all rows is
already one row a run before the first exchange. The root knows each digest's
survivor; the way back down hands it from each merged run to the runs that it
came from, so no level ever gathers all copies of a text in one task.

DataFrame operations only. Texts count as equal when SHA-256, byte length and
a second, independent 64-bit hash all agree; that is checked at every level.

Defined results: null text counts as empty; all empty texts are copies of each
other; a null identifier loses against any other and a group of null
identifiers only keeps null; rows that repeat an identifier and its text are
copies like any other and exactly one of them is kept; an empty table gives an
empty result. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

_KEY = ["digest", "n_bytes", "second"]


def _digests(text: Column) -> list[Column]:
    return [F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("second")]


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "max", fan_in: int = 8, row_col: str | None = None
) -> DataFrame:
    """One row per input row: ``id``, ``digest``, ``n_bytes``, ``second``, ``keep_id``, ``group_size``, ``kept``, ``seq``.

    ``keep`` is ``max`` or ``min``: which identifier of a group stays.
    ``row_col`` numbers the rows (``seq``); without it they are numbered here.
    """
    if keep not in ("max", "min") or fan_in < 2:
        raise ValueError("keep is 'max' or 'min', fan_in 2 at least")
    best = F.max if keep == "max" else F.min
    number = F.col("seq") if row_col else F.monotonically_increasing_id()
    given = [F.col(row_col).alias("seq")] if row_col else []
    runs = cut(
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *given)
        .select("id", *_digests(F.col("text")), F.spark_partition_id().alias("run"), number.alias("seq"))
        .sortWithinPartitions("digest"),
        "digest-runs",
    )
    last = runs.agg(F.max("run")).first()[0] or 0
    # The row's own number breaks ties between rows that repeat an identifier; null ids come last.
    order = F.struct(F.col("id").isNotNull().alias("has") if keep == "max" else F.col("id").isNull().alias("has"), "id", "seq")
    level = runs.groupBy(*_KEY, "run").agg(best(order).alias("best"), F.count("*").alias("n"))
    levels = [level]
    while last > 0:
        last //= fan_in
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy(*_KEY, "run")
            .agg(best("best").alias("best"), F.sum("n").alias("n"))
        )
        levels.append(level)
    known = levels.pop()
    for lower in reversed(levels):
        up = known.select(*_KEY, F.col("run").alias("above"), "best", "n")
        lower = lower.select(*_KEY, "run", F.floor(F.col("run") / fan_in).cast("int").alias("above"))
        known = lower.join(up, [*_KEY, "above"]).drop("above")
    return runs.join(known, [*_KEY, "run"]).select(
        "id", *_KEY, F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("best.seq") == F.col("seq")).alias("kept"), "seq"
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "max", fan_in: int = 8
) -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops, columns unchanged.

    Rows are numbered once in a written table, so of rows that repeat both
    identifier and text one stays.
    """
    row = fresh(docs, "_row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    lost = exact_duplicates(numbered, id_col, text_col, keep=keep, fan_in=fan_in, row_col=row).where(~F.col("kept")).select(F.col("seq").alias(row))
    return numbered.join(lost, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
