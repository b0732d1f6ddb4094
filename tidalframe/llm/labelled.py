"""A bounded, deterministic sample of labelled documents for the driver to fit on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, *, id_col: str = "doc_id", text_col: str = "text", per_class: int
) -> tuple[list[str], list[int], float]:
    """At most ``per_class`` texts of each label 0 and 1, those of least identifier hash.

    Returns texts, labels, and the share of 1 among all labels.

    Rows without a label or an identifier are left out, a null text is empty; of
    documents that share an identifier the one of least text counts.
    The ids (bounded by ``2 * per_class``) are broadcast, so the documents are
    scanned and not shuffled; only the sampled texts reach the driver, whole.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    share = known.agg(F.avg("_label")).first()[0]
    order = F.xxhash64(F.col("_id").cast("string"))
    parts = [known.where(F.col("_label") == k).groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(order, "_id").limit(per_class) for k in (0, 1)]
    picked = parts[0].union(parts[1])
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(picked), "_id")
    # One text an id, whatever the number of its rows: no more than ``2 * per_class`` texts can reach the driver.
    table: pa.Table = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label")).toArrow()
    found = sorted(zip(table["_id"].to_pylist(), table["_label"].to_pylist(), table["_text"].to_pylist(), strict=True), key=lambda r: (str(r[0]), r[1], r[2]))
    return [r[2] for r in found], [r[1] for r in found], float(share or 0.0)
