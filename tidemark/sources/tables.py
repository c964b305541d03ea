"""Series and results at rest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.series import admissible, content_hash, summary

SCHEMA = "series_id string, source string, domain string, freq string, timestamp timestamp, value double"


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """The long table with sid, ts, v and the source, domain and freq of a series' first row; nanoseconds are cut."""
    # a setting of the session and not of the reader: files with nanoseconds can't be opened without it
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    df = spark.read.parquet(path)
    if dict(df.dtypes)["timestamp"] == "bigint":
        df = df.withColumn("timestamp", F.expr("timestamp_micros(timestamp div 1000)"))
    first = Window.partitionBy("series_id").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(F.col("series_id").alias("sid"), F.col("timestamp").alias("ts"), F.nanvl("value", F.lit(None).cast("double")).alias("v"), *[F.first(c).over(first).alias(c) for c in ("source", "domain", "freq")])


def write_series(df: DataFrame, path: str, files: int | None = None) -> None:
    """The long table as Parquet; by source, or in ``files`` files."""
    out = df.select(F.col("sid").alias("series_id"), "source", "domain", "freq", F.col("ts").alias("timestamp"), F.col("v").alias("value"))
    if files:
        out.coalesce(files).write.mode("overwrite").parquet(path)
    else:
        out.write.mode("overwrite").partitionBy("source").parquet(path)


def read_wide_csv(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    """A CSV with a date and a column per channel as (sid, ts, v)."""
    df = spark.read.csv(path, header=True)
    channels = [c for c in df.columns if c != date]
    return df.select(F.to_timestamp(date).alias("ts"), *[F.col(f"`{c}`").cast("double").alias(c) for c in channels]).unpivot(["ts"], channels, "sid", "v").select("sid", "ts", "v")


def read_sequences(df: DataFrame, item: str = "item_id", times: str = "timestamp") -> DataFrame:
    """A dataset with one array per column and row: every array column but the times is a series of its own, in one scan."""
    arrays = [c for c, kind in df.dtypes if kind.startswith("array") and c != times]
    columns = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("array<double>").alias("v")) for c in arrays])
    each = df.select(F.col(item).cast("string").alias("item"), F.col(times).alias("ts"), F.explode(columns).alias("c"))
    return each.select(F.concat_ws(":", "item", "c.name").alias("sid"), F.inline(F.arrays_zip(F.col("ts").alias("ts"), F.col("c.v").alias("v"))))


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """(sid, start, freq, target) of a nested dataset, for ``windows.nested_windows``; targets stay arrays of any depth."""
    df = spark.read.parquet(path)
    return df.select(F.col("item_id").cast("string").alias("sid"), F.col("start").cast("timestamp").alias("start"), "freq", "target")


def published_results(spark: SparkSession, path: str, score: str = "MASE", key: str = "dataset") -> DataFrame:
    """(sid, ref) from a CSV; the score's name may hold dots and brackets."""
    return spark.read.csv(path, header=True).select(F.col(f"`{key}`").alias("sid"), F.col(f"`{score}`").cast("double").alias("ref"))


def latest(names: DataFrame, name: str = "name", pattern: str = "fresh_*.parquet") -> DataFrame:
    """The last snapshot by name."""
    like = pattern.replace(".", r"\.").replace("*", ".*")
    return names.where(F.col(name).rlike(f"^{like}$")).agg(F.max(name).alias(name))


def frozen(df: DataFrame, context: int, horizon: int) -> DataFrame:
    """Frozen inputs whose arrays have the sizes they should; others raise."""
    good = (F.size("context") == context) & (F.size("target") == horizon)
    return df.where(F.when(good, True).otherwise(F.raise_error(F.lit("frozen inputs have another shape")).cast("boolean")))


def status_of_size(mb: Column, cap: float) -> Column:
    return F.when(mb > cap, "skipped_size").otherwise("searched")


def files_sha256(spark: SparkSession, path: str) -> str:
    """SHA-256 of a folder's one data file, or over the sorted digests of several, each read once by an executor."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    found = sorted(r.h for r in files.select(F.sha2("content", 256).alias("h")).collect())
    return found[0] if len(found) == 1 else hashlib.sha256("".join(found).encode()).hexdigest()


def manifest(df: DataFrame, status: DataFrame, window: tuple[str, str], cutoff: str, dropped: int, fetched_at: str, data_file: str, data_sha256: str, metadata: DataFrame | None = None) -> dict:
    """What a snapshot holds: sources, totals and a line per series, with its metadata (sid, metadata) if given."""
    lines = summary(df).join(content_hash(df), "sid")
    if metadata is not None:
        lines = lines.join(metadata.select("sid", "metadata"), "sid", "left")
    lines = lines.orderBy("sid")
    series = [json.loads(x) for x in lines.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]
    return {
        "schema_version": 1, "fetched_at_utc": fetched_at, "window": {"start": window[0], "end": window[1]}, "admissibility_cutoff": cutoff,
        "observations_dropped_before_cutoff": dropped, "sources": {r.source: {"ok": r.ok, "n_series": r.n_series, "error": r.error} for r in status.collect()},
        "n_series": len(series), "n_observations": sum(x["n_obs"] for x in series), "data_file": data_file, "data_sha256": data_sha256, "series": series,
    }


def snapshot(spark: SparkSession, observations: DataFrame, status: DataFrame, path: str, window: tuple[str, str], cutoff: str, fetched_at: str, metadata: DataFrame | None = None) -> dict:
    """Keep what is admissible, write it and its manifest, and return the manifest, which describes the file as read back."""
    kept = admissible(observations, cutoff)
    dropped = observations.where(F.col("ts") < F.lit(cutoff).cast("timestamp")).count()
    full = kept.withColumns({c: F.lit(None).cast("string") for c in ("source", "domain", "freq") if c not in kept.columns})
    write_series(full, f"{path}.parquet", files=1)
    back = read_series(spark, f"{path}.parquet").select("sid", "ts", "v")
    out = manifest(back, status, window, cutoff, dropped, fetched_at, f"{path}.parquet", files_sha256(spark, f"{path}.parquet"), metadata)
    spark.createDataFrame([(json.dumps(out, indent=2, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")
    return out
