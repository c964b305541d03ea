"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import remove, shared_dir, table
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.packing import pack
from tidemark.llm.quality import keep_good
from tidemark.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; see ``keep_good``. Each row is judged by its own text."""
    return keep_good(docs, table(spark, sf_dir, "labels"), folds=5, held=0, threshold=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id; rows that repeat id and text are one."""
    keyed = lambda df, sha: df.withColumns({"_k": F.coalesce("doc_id", F.lit(-(1 << 62))), "_sha": sha})
    keep = keyed(exact_dedup(docs, keep="min").where("kept"), F.col("text_sha256")).select("_k", "_sha")
    marked = keyed(docs, F.sha2(F.coalesce("text", F.lit("")), 256))
    # one exchange of the texts serves the join and what follows
    return marked.join(keep, ["_k", "_sha"], "left_semi").dropDuplicates(["_k", "_sha"]).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, at 0.8 or more on five-word shingles, the document with the smallest id; see ``keep_one``."""
    return keep_one(docs, words=5)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item; see ``decontaminate``. Each row is judged by its own text."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, with their place in windows of 2048; see ``pack`` for nulls and repeated rows."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", leaks), ("packing", packing)]

#: The classifier's trees and the components have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written in the shared folder and read again as the next one's docs.

    A result is deleted when the next one is written; the last of them, which the packed rows are read from, stays.
    Empty tables of documents, labels or benchmark are worked on like others: nothing to learn from keeps every document.
    """
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            remove(spark, f"{at}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
