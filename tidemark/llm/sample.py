"""Bounded samples of labelled rows, chosen by a hash of the id so that a rerun takes the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1_000_003


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, id_col: str = "doc_id", text_col: str = "text", by_label: bool = False) -> DataFrame:
    """(doc_id, text, label) for about ``rows`` labelled documents whose label row satisfies ``keep``.

    Rows are taken by a hash of the id against a threshold of ``rows`` over their number; with ``by_label`` each
    label has its own threshold, for half of ``rows``. An id with several labels has their rounded mean; null
    labels and ids are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & keep).groupBy(id_col).agg(F.round(F.avg(label)).cast("int").alias("label"))
    many = {r.label: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    limit = lambda n, of: int(min(1.0, n / max(1, of)) * _STEPS) + 1
    below = F.lit(limit(rows, sum(many.values())))
    if by_label:
        below = F.when(F.col("label") == 1, limit(rows / 2, many.get(1, 0))).otherwise(limit(rows / 2, many.get(0, 0)))
    taken = known.where(F.pmod(F.xxhash64(id_col), F.lit(_STEPS)) < below).select(F.col(id_col).alias("_id"), "label")
    # at most about `rows` ids of 12 bytes, whatever the size of the tables
    return docs.join(F.broadcast(taken), F.col(id_col) == F.col("_id")).select(F.col("_id").alias("doc_id"), F.col(text_col).cast("string").alias("text"), "label")
