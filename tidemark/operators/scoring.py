"""Scaled errors, quantile losses and comparison with published scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import deviation_band, deviation_pct, pinball, relative_difference
from .series import positions
from .windows import with_window_count


def seasonal_error(split: DataFrame, m: Column | int, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, m, err): mean absolute difference at lag m of the past, at lag 1 if it is shorter than a season.

    A past as long as its lag has no difference and gives NULL, as do missing values all through.
    """
    whole = Window.partitionBy(*keys)
    p = split.where("part = 'past'").select(*keys, F.col("step").alias("pos"), "v", (m if isinstance(m, Column) else F.lit(m)).cast("int").alias("m"))
    p = p.withColumn("n", F.count(F.lit(1)).over(whole))
    if isinstance(m, int):
        # one season for all: the earlier value is in the same sorted partition
        by_pos = whole.orderBy("pos")
        p = p.withColumn("u", F.when(F.col("n") >= m, F.lag("v", m).over(by_pos)).otherwise(F.lag("v", 1).over(by_pos)))
    else:
        p = p.withColumn("lag", F.when(F.col("n") >= F.col("m"), F.col("m")).otherwise(1))
        earlier = p.select(*keys, (F.col("pos") + F.col("lag")).alias("pos"), F.col("v").alias("u"))
        p = p.join(earlier, [*keys, "pos"], "left")
    return p.groupBy(*keys).agg(F.first("m").alias("m"), F.avg(F.abs(F.col("v") - F.col("u"))).alias("err"))


def mase(split: DataFrame, forecasts: DataFrame, errors: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, mase): mean absolute error over the seasonal error; NULL where that is zero or undefined."""
    target = split.where("part = 'target'").select(*keys, "step", "v")
    off = target.join(forecasts, [*keys, "step"]).groupBy(*keys).agg(F.avg(F.abs(F.col("v") - F.col("yhat"))).alias("mae"))
    return off.join(errors, list(keys)).select(*keys, (F.col("mae") / F.nullif(F.col("err"), F.lit(0.0))).alias("mase"))


def rolling_mase(df: DataFrame, h: int, m: int, windows: int | None = None) -> DataFrame:
    """(sid, window_index, mase) of the seasonal-naive forecast over rolling windows, with no copy of any past.

    A point is a target of one window only, and its forecast stands a whole number of seasons before it. What a past's
    seasonal error needs are running sums of differences, read where its target begins. So one sorted pass over a series
    gives all its windows. A past shorter than a season has the last value as forecast and differences at lag 1.
    """
    p = with_window_count(df, positions(df), h, windows)
    by_pos = Window.partitionBy("sid").orderBy("pos")
    before = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    seasons = range(1, -(-h // m) + 1)
    p = p.withColumns({
        **{f"u{k}": F.lag("v", k * m).over(by_pos) for k in seasons},
        **{f"e{lag}": F.abs(F.col("v") - F.lag("v", lag).over(by_pos)) for lag in {1, m}},
        "u": F.lag("v", 1).over(by_pos),
    })
    p = p.withColumns({f"err{lag}": F.avg(f"e{lag}").over(before) for lag in {1, m}})
    from_first = F.col("pos") - (F.col("n") - h * F.col("w"))
    p = p.withColumns({"window_index": F.floor(from_first / h).cast("int"), "step": F.pmod(from_first, F.lit(h)).cast("int")})
    p = p.withColumn("start", F.col("pos") - F.col("step")).where((from_first >= 0) & (F.col("start") > 0))
    last = F.first("u").over(Window.partitionBy("sid", "window_index").orderBy("pos"))
    seasonal = F.get(F.array(*[F.col(f"u{k}") for k in seasons]), F.floor(F.col("step") / m).cast("int"))
    p = p.withColumn("yhat", F.when(F.col("start") >= m, seasonal).otherwise(last))
    err = F.when(F.col("start") >= m, F.col(f"err{m}")).otherwise(F.col("err1"))
    held = p.groupBy("sid", "window_index").agg(F.avg(F.abs(F.col("v") - F.col("yhat"))).alias("mae"), F.max(F.when(F.col("step") == 0, err)).alias("err"), F.count(F.lit(1)).alias("points"))
    return held.where(F.col("points") == h).select("sid", "window_index", (F.col("mae") / F.nullif(F.col("err"), F.lit(0.0))).alias("mase"))


def array_mase(x: Column, h: int, m: int) -> Column:
    """The seasonal-naive MASE of one series held as an array whose last ``h`` values are the target.

    The same figures as ``mase`` gives, for ensembles of short series: a member is one row and needs no exchange.
    """
    cut = F.size(x) - h
    lag = F.when(cut >= m, m).otherwise(1)
    total = lambda a: F.aggregate(a, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda s, v: F.when(v.isNull(), s).otherwise(F.struct((s["s"] + v).alias("s"), (s["n"] + 1).alias("n"))), lambda s: s["s"] / F.nullif(s["n"], F.lit(0)))
    off = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda t: F.abs(F.get(x, cut + t) - F.get(x, F.when(cut >= m, cut - m + t % m).otherwise(cut - 1))))
    steps = F.when(cut > lag, F.sequence(lag, cut - 1)).otherwise(F.array().cast("array<int>"))
    err = total(F.transform(steps, lambda i: F.abs(F.get(x, i) - F.get(x, i - lag))))
    return F.when(cut > 0, total(off) / F.nullif(err, F.lit(0.0)))


def quantile_losses(split: DataFrame, forecasts: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, q, loss): mean doubled pinball loss per level."""
    target = split.where("part = 'target'").select(*keys, "step", "v")
    return target.join(forecasts, [*keys, "step"]).groupBy(*keys, "q").agg(F.avg(pinball(F.col("v"), F.col("yhat"), F.col("q"))).alias("loss"))


def wql(split: DataFrame, forecasts: DataFrame, group: Column, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(family, wql): losses pooled over all targets of a family per level, over the pooled size, mean over levels.

    A missing forecast drops from the losses; its target still counts in the size.
    """
    target = split.where("part = 'target'").select(*keys, "step", "v")
    size = target.groupBy(group.alias("family")).agg(F.sum(F.abs("v")).alias("size"))
    loss = target.join(forecasts, [*keys, "step"]).groupBy(group.alias("family"), "q").agg(F.sum(pinball(F.col("v"), F.col("yhat"), F.col("q"))).alias("loss"))
    return loss.join(size, "family").groupBy("family").agg(F.avg(F.col("loss") / F.nullif(F.col("size"), F.lit(0.0))).alias("wql"))


crps = quantile_losses  # the continuous score is approximated by the mean quantile loss over levels


def against_published(scores: DataFrame, published: DataFrame, key: str = "sid", strict: bool = False) -> DataFrame:
    """Scores beside published ones; with ``strict`` a score without one raises, else its columns are NULL."""
    joined = scores.join(published, key, "left")
    if strict:
        joined = joined.where(F.when(F.col("ref").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no published score for "), F.col(key))).cast("boolean")))
    return joined.withColumn("dev_pct", deviation_pct(F.col("mase"), F.col("ref")))


def within_band(scores: DataFrame, n: str = "n") -> DataFrame:
    return scores.withColumn("band_pct", deviation_band(F.col(n))).withColumn("pass", F.abs("dev_pct") <= F.col("band_pct"))


def median_ratio(model: DataFrame, naive: DataFrame, group: Column, key: str = "sid") -> DataFrame:
    """Median over series of a model's score over the naive one."""
    pair = model.select(key, F.col("mase").alias("a")).join(naive.select(key, F.col("mase").alias("b")), key)
    return pair.groupBy(group.alias("family")).agg(F.median(F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).alias("ratio"))


def equivalence(split: DataFrame, ours: DataFrame, theirs: DataFrame, errors: DataFrame, most_relative: float = 1e-3, most_mase_pct: float = 0.5, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """One row on whether two sets of forecasts may stand for each other: relative differences point by point, and mean MASE.

    They may if the median relative difference is below ``most_relative`` and the scores differ by less than
    ``most_mase_pct`` percent. A forecast that only one side has is an error of the exchange and raises.
    """
    both = ours.select(*keys, "step", F.col("yhat").alias("a")).join(theirs.select(*keys, "step", F.col("yhat").alias("b")), [*keys, "step"], "full")
    whole = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a")).otherwise(F.raise_error(F.lit("a forecast is missing on one side")).cast("double"))
    both = both.withColumn("a", whole)
    apart, relative = F.abs(F.col("a") - F.col("b")), relative_difference(F.col("a"), F.col("b"))
    points = both.agg(F.count(F.lit(1)).alias("points"), F.median(relative).alias("median_rel"), F.percentile(relative, F.lit(0.95)).alias("p95_rel"), F.max(relative).alias("max_rel"), F.max(apart).alias("max_abs"))
    one = lambda f, name: mase(split, f, errors, keys).agg(F.avg("mase").alias(name))
    held = points.crossJoin(one(ours, "mase_a")).crossJoin(one(theirs, "mase_b"))
    held = held.withColumn("mase_diff_pct", 100 * F.abs(F.col("mase_b") - F.col("mase_a")) / F.nullif(F.col("mase_a"), F.lit(0.0)))
    return held.withColumn("equivalent", F.coalesce((F.col("median_rel") < most_relative) & (F.col("mase_diff_pct") < most_mase_pct), F.lit(False)))


def spread(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """mean, sample deviation, least, largest and relative deviation in percent."""
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), F.median(value).alias("median")).withColumn("rel_sd_pct", 100 * F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0)))
