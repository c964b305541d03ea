"""Regular grids, gaps, admissibility and summaries.

Every operator takes the long table (sid, ts, v) and keeps to one window layout, partitioned by sid and ordered
by ts, so that a chain of them sorts once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ..functions.expressions import n_windows


def by_time() -> WindowSpec:
    return Window.partitionBy("sid").orderBy("ts")


def whole() -> WindowSpec:
    return Window.partitionBy("sid")


def canonical(df: DataFrame, sid: Column, ts: Column, value: Column) -> DataFrame:
    """The long table; NaN becomes NULL."""
    return df.select(sid.cast("string").alias("sid"), ts.cast("timestamp").alias("ts"), F.nanvl(value.cast("double"), F.lit(None).cast("double")).alias("v"))


def zipped(df: DataFrame, sid: str, times: str, values: str) -> DataFrame:
    """Parallel arrays as the long table; arrays of different lengths raise."""
    same = F.when(F.size(times) == F.size(values), F.arrays_zip(F.col(times).alias("ts"), F.col(values).alias("v"))).otherwise(F.raise_error(F.lit("timestamps and values differ in length")).cast("array<struct<ts:timestamp,v:double>>"))
    return df.select(F.col(sid).alias("sid"), F.inline(same)).toDF("sid", "ts", "v")


def positions(df: DataFrame) -> DataFrame:
    """pos counts from 0 by time within a series, n is the length; lags are positional."""
    return df.withColumns({"pos": (F.row_number().over(by_time()) - 1).cast("bigint"), "n": F.count(F.lit(1)).over(whole())})


def resample(df: DataFrame, unit: str = "hour") -> DataFrame:
    """Mean per unit of time; units without a point between the first and the last are NULL."""
    seen = df.groupBy("sid", F.date_trunc(unit, "ts").alias("ts")).agg(F.avg("v").alias("v"))
    grid = seen.groupBy("sid").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("sid", F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias("ts"))
    return grid.join(seen, ["sid", "ts"], "left")


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in ``order``, whole; a partial aggregate, so hot keys merge before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = [*order, *(c for c in rest if c not in order)]
    return df.groupBy(*keys).agg(F.min(F.struct(*rank)).alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def admissible(df: DataFrame, cutoff: str) -> DataFrame:
    """Observations at the cutoff or later."""
    return df.where(F.col("ts") >= F.lit(cutoff).cast("timestamp"))


def admissibility(df: DataFrame, cutoff: str) -> DataFrame:
    """Per series how many observations the cutoff keeps and drops; series with none left are dropped."""
    at = F.lit(cutoff).cast("timestamp")
    return df.groupBy("sid").agg(F.count_if(F.col("ts") >= at).alias("n_kept"), F.count_if(F.col("ts") < at).alias("n_dropped"), F.min(F.when(F.col("ts") >= at, F.col("ts"))).alias("first_ts")).where("n_kept > 0")


def summary(df: DataFrame) -> DataFrame:
    return df.groupBy("sid").agg(F.count(F.lit(1)).alias("n_obs"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.min("ts").alias("start"), F.max("ts").alias("end")).withColumn("n_windows", n_windows(F.col("n_obs")))


def modal_step(df: DataFrame) -> DataFrame:
    """The commonest step in microseconds, the smallest on a tie; NULL for a single point."""
    step = df.select("sid", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by_time()))).alias("d"))
    return step.groupBy("sid").agg(F.mode("d", True).alias("step_us"))


def segments(df: DataFrame, min_length: int) -> DataFrame:
    """Observations of gap-free runs of at least ``min_length``: sid, ts, v, segment_number, segments_found, pos.

    A missing value or a step other than the modal one ends a run. Runs are numbered before short ones are
    dropped. The modal step is a small table by series, joined back; nothing else leaves the sorted partition.
    """
    stepped = df.join(modal_step(df), "sid")
    before, value_before = F.lag("ts").over(by_time()), F.lag("v").over(by_time())
    starts = F.col("v").isNotNull() & (before.isNull() | value_before.isNull() | (F.unix_micros("ts") - F.unix_micros(before) != F.col("step_us")))
    marked = stepped.withColumn("segment_number", F.sum(starts.cast("int")).over(by_time().rowsBetween(Window.unboundedPreceding, 0))).where(F.col("v").isNotNull())
    run = Window.partitionBy("sid", "segment_number")
    found = marked.withColumns({"segments_found": F.max("segment_number").over(whole()), "n": F.count(F.lit(1)).over(run), "pos": F.row_number().over(run.orderBy("ts")) - 1})
    return found.where(F.col("n") >= min_length).select("sid", "ts", "v", F.col("segment_number").cast("int"), F.col("segments_found").cast("int"), F.col("pos").cast("bigint"), "n")


def segment_id(sid: Column, number: Column) -> Column:
    return F.concat(sid, F.lit("#s"), number.cast("string"))


def segment_table(df: DataFrame, min_length: int) -> DataFrame:
    return segments(df, min_length).groupBy("sid", "segment_number", "segments_found").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))


def unpivot(df: DataFrame, ts: str, channels: list[str]) -> DataFrame:
    """Each column of a wide table as a series."""
    return df.unpivot([ts], channels, "channel", "v").withColumnRenamed(ts, "ts")


def dimensions(df: DataFrame, sid: str, target: str) -> DataFrame:
    """Each row of an array of arrays as a series of its own: sid, dimension, values."""
    return df.select(F.col(sid).alias("sid"), F.posexplode(target).alias("dimension", "values"))


def tail(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` observations of each series, with positions from 0."""
    return positions(positions(df).where(F.col("pos") >= F.col("n") - n).select("sid", "ts", "v"))


def even_sample(df: DataFrame, many: int) -> DataFrame:
    """Every max(1, n // many)-th observation, ``many`` of them at most."""
    step = F.greatest(F.lit(1), F.floor(F.col("n") / many))
    return positions(df).where((F.col("pos") % step == 0) & (F.col("pos") / step < many)).select("sid", "pos", "v")


def drop_missing(df: DataFrame, least: int = 1) -> DataFrame:
    """Observations with a value, of series that have at least ``least`` of them."""
    known = df.where(F.col("v").isNotNull())
    if least <= 1:
        return known
    return known.withColumn("_n", F.count(F.lit(1)).over(whole())).where(F.col("_n") >= least).drop("_n")


def merged_metadata(old: Column, new: Column) -> Column:
    """All keys of both maps, with the value of ``new`` where both have one; a null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def segment_metadata(table: DataFrame, metadata: DataFrame) -> DataFrame:
    """(sid, metadata) of the segments in ``table``, as ``segment_table`` gives them: the parent's entries and their place in it."""
    own = F.create_map(
        F.lit("parent_series_id"), F.col("sid"), F.lit("segment_number"), F.col("segment_number").cast("string"), F.lit("segments_found"), F.col("segments_found").cast("string")
    )
    return table.join(metadata, "sid", "left").select(segment_id(F.col("sid"), F.col("segment_number")).alias("sid"), merged_metadata(F.col("metadata"), own).alias("metadata"))


def longest_run(df: DataFrame) -> DataFrame:
    """The longest gap-free run of each series, the first of equals."""
    runs = segments(df, 1)
    best = runs.groupBy("sid").agg(F.max_by("segment_number", F.struct("n", -F.col("segment_number"))).alias("segment_number"))
    return runs.join(best, ["sid", "segment_number"]).select("sid", "ts", "v")


@F.pandas_udf(T.StringType())
def _hash(values: pd.Series) -> pd.Series:
    as_bytes = lambda v: np.array([np.nan if x is None else x for x in v], "<f8").tobytes()
    return values.map(lambda v: hashlib.sha256(as_bytes(v)).hexdigest()[:16])


def content_hash(df: DataFrame) -> DataFrame:
    """Sixteen hex digits over the values as little-endian doubles in time order, NULL as NaN."""
    return df.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("ts", "v"))).alias("o")).select("sid", _hash(F.transform("o", lambda x: x["v"])).alias("content_hash"))
