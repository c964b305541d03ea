"""Backtest windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import positions


def split_fixed(df: DataFrame, offset: int, h: int) -> DataFrame:
    """(sid, part, step, v): everything before ``offset`` as past, the next ``h`` points as target.

    Series without a past or with a short target give no rows.
    """
    if offset >= 0 or h <= 0:
        raise ValueError("offset must be negative and h positive")
    p = positions(df)
    cut = F.col("n") + offset
    p = p.where((cut > 0) & (h <= -offset) & (F.col("pos") < cut + h))
    is_past = F.col("pos") < cut
    return p.select("sid", F.when(is_past, "past").otherwise("target").alias("part"), F.when(is_past, F.col("pos")).otherwise(F.col("pos") - cut).alias("step"), "v")


def split_by_config(df: DataFrame, configs: DataFrame, dataset: Column) -> DataFrame:
    """``split_fixed`` for many datasets at once: ``configs`` (name, offset, h) are few and give each series its own split."""
    named = df.withColumn("_name", dataset).join(F.broadcast(configs.select(F.col("name").alias("_name"), "offset", "h")), "_name")
    p = positions(named).withColumn("cut", F.col("n") + F.col("offset"))
    p = p.where((F.col("cut") > 0) & (F.col("h") <= -F.col("offset")) & (F.col("pos") < F.col("cut") + F.col("h")))
    is_past = F.col("pos") < F.col("cut")
    step = F.when(is_past, F.col("pos")).otherwise(F.col("pos") - F.col("cut"))
    return p.select("sid", F.when(is_past, "past").otherwise("target").alias("part"), step.cast("bigint").alias("step"), "v")


def nested_windows(targets: DataFrame, h: int, windows: int | None = None) -> DataFrame:
    """(sid, dimension, window_index, past, target) of series held as arrays of values or of arrays (sid, target).

    Each inner array is a series of its own. Without ``windows`` the shortest of them all sets the number of windows,
    which is an aggregate of one row.
    """
    if dict(targets.dtypes)["target"].startswith("array<array"):
        each = targets.select("sid", F.posexplode("target").alias("dimension", "x"))
    else:
        each = targets.select("sid", F.lit(0).alias("dimension"), F.col("target").alias("x"))
    if windows is None:
        least = each.agg(F.min(F.size("x")).alias("_least"))
        count = F.least(F.greatest(F.ceil(0.1 * F.col("_least") / h), F.lit(1)), F.lit(20)).cast("int")
        each = each.crossJoin(F.broadcast(least)).withColumn("w", count)
    else:
        each = each.withColumn("w", F.lit(windows))
    each = each.withColumn("window_index", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    start = F.size("x") - h * (F.col("w") - F.col("window_index"))
    return each.where(start > 0).select("sid", "dimension", "window_index", F.slice("x", 1, start).alias("past"), F.slice("x", start + 1, h).alias("target"))


def with_window_count(df: DataFrame, p: DataFrame, h: int, windows: int | None) -> DataFrame:
    """``p`` with the number ``w`` of rolling windows; without ``windows`` it follows the shortest series of ``df``, a one-row aggregate."""
    if windows is not None:
        return p.withColumn("w", F.lit(windows))
    least = df.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    return p.crossJoin(F.broadcast(least)).withColumn("w", F.least(F.greatest(F.ceil(0.1 * F.col("least") / h), F.lit(1)), F.lit(20)))


def rolling(df: DataFrame, h: int, windows: int | None = None) -> DataFrame:
    """One row per point of each rolling window: sid, window_index, part, step, ts, v.

    Window i starts h * (w - i) before the end; its past reaches back to the start. Scores of many windows are had
    without these rows by ``scoring.rolling_mase``.
    """
    p = with_window_count(df, positions(df), h, windows)
    each = p.withColumn("window_index", F.explode(F.sequence(F.lit(0), F.col("w").cast("int") - 1)))
    start = F.col("n") - h * (F.col("w") - F.col("window_index"))
    each = each.where((start > 0) & (F.col("pos") < start + h))
    return each.select("sid", "window_index", F.when(F.col("pos") < start, "past").otherwise("target").alias("part"), F.when(F.col("pos") < start, F.col("pos")).otherwise(F.col("pos") - start).cast("bigint").alias("step"), "ts", "v")


def rolling_table(df: DataFrame, h: int, windows: int | None = None) -> DataFrame:
    target = F.col("part") == "target"
    return (
        rolling(df, h, windows).groupBy("sid", "window_index")
        .agg(F.count_if(~target).alias("n_past"), F.min(F.when(target, F.col("ts"))).alias("target_start"), F.sum(F.when(target, F.col("v"))).alias("target_sum"))
    )


def backward(df: DataFrame, context: int, h: int, windows: int = 10) -> DataFrame:
    """Windows of ``context`` and ``h`` points from the end backwards, as many as fit: sid, k, past_start, target_end."""
    n = df.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    end = F.col("n") - F.col("k") * h
    return n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(windows - 1)))).where(end - h >= context).select("sid", "k", (end - h - context).alias("past_start"), end.alias("target_end"))


def first_per_domain(segment_table: DataFrame, domain: str = "domain") -> DataFrame:
    """The first segment of each domain by series and number."""
    rest = ["sid", "segment_number", *(c for c in segment_table.columns if c not in (domain, "sid", "segment_number"))]
    return segment_table.groupBy(domain).agg(F.min(F.struct(*rest)).alias("f")).select(domain, "f.*")


def query_windows(df: DataFrame, w: int) -> DataFrame:
    """The first ``w`` points and the ``w`` points around the middle of each series, as arrays."""
    p = positions(df)
    mid = F.floor(F.col("n") / 2)
    cuts = p.withColumn("cut", F.explode(F.array(F.lit("start"), F.lit("middle")))).withColumn("from", F.when(F.col("cut") == "start", 0).otherwise(mid))
    inside = cuts.where((F.col("pos") >= F.col("from")) & (F.col("pos") < F.col("from") + w))
    held = inside.groupBy("sid", "cut").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("o"))
    return held.where(F.size("o") == w).select("sid", "cut", F.transform("o", lambda x: x["v"]).alias("values"))


def as_arrays(split: DataFrame, keys: list[str]) -> DataFrame:
    """Long windows as arrays: keys, past, target."""
    held = split.groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("step", "v")))).alias(p) for p in ("past", "target")])
    return held.select(*keys, *[F.transform(p, lambda x: x["v"]).alias(p) for p in ("past", "target")])


def left_pad(df: DataFrame, column: str, size: int) -> DataFrame:
    """An array cut to its last ``size`` values or padded in front with zeros, with masks of padding and of known values."""
    n = F.size(column)
    kept = F.slice(column, F.greatest(n - size + 1, F.lit(1)), size)
    pad = F.greatest(F.lit(size) - n, F.lit(0))
    return df.withColumns({
        "padded": F.concat(F.array_repeat(F.lit(0.0), pad), F.transform(kept, lambda x: F.coalesce(x, F.lit(0.0)))),
        "is_pad": F.concat(F.array_repeat(F.lit(True), pad), F.transform(kept, lambda x: F.lit(False))),
        "observed": F.concat(F.array_repeat(F.lit(False), pad), F.transform(kept, lambda x: x.isNotNull())),
    })
