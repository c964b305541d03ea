"""Results that are kept: keyed upserts, replacement, append and per-dataset overwrite."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All keys of both, the row of the later one where both have it; ``order`` decides among rows of one batch."""
    both = old.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    rest = [c for c in both.columns if c not in keys and c != "batch" and c not in order]
    last = both.groupBy(*keys).agg(F.max(F.struct("batch", *order, *rest)).alias("l"))
    return last.select(*keys, "l.*")


def not_replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the new batch doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti")


def append(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("append").format(kind).save(path)


def overwrite(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> None:
    df.write.mode("overwrite").options(**options).format(kind).save(path)


def overwrite_datasets(df: DataFrame, path: str, by: str = "dataset") -> None:
    """Replace only the datasets that ``df`` has, so that each one done is kept."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def guarded(spark: SparkSession, datasets: list[str], score: Callable[[str], DataFrame], most: int = 120, path: str | None = None) -> DataFrame:
    """Scores of all datasets that can be scored, and a row with the start of the error for each that can't.

    ``score`` gives a dataset's result; it is computed here, so that a failure shows and stops no other dataset. With a
    folder ``path`` it is written there and read back; without one the reader computes it again.
    """
    out = spark.createDataFrame([], "dataset string, error string")
    for name in datasets:
        try:
            rows = score(name).withColumns({"dataset": F.lit(name), "error": F.lit(None).cast("string")})
            if path:
                rows.write.mode("overwrite").parquet(f"{path}/{name}")
                rows = spark.read.parquet(f"{path}/{name}")
            else:
                rows.write.format("noop").mode("overwrite").save()
        except Exception as e:
            rows = spark.createDataFrame([(name, str(e)[:most])], "dataset string, error string")
        out = out.unionByName(rows, allowMissingColumns=True)
    return out
