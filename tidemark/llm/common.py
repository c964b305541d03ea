"""What the training-data operators share: table access, lineage cuts and Arrow helpers."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the session's, or that of spark.checkpoint.dir; only a local master makes do with a temporary one."""
    sc = spark.sparkContext
    set_already = sc.getCheckpointDir()
    if set_already:
        return set_already
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    where = where or tempfile.mkdtemp(prefix="tidemark-")
    sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now, in the shared folder, so that a lost executor costs no recomputation of its past."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Ids or digests up to which a set is sent to every task (under 100 bytes each); beyond, both sides are shuffled.
BROADCAST_IDS = 200_000


def few_rows(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that only a few of its texts are Python objects at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def blobs(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column as bytes; null counts as empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The values of a string column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def batches(rows: list[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a bounded number of rows."""
    for i in range(0, len(rows), size):
        columns = zip(*rows[i : i + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
