"""From scores of real and surrogate series to verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import derive_seed


def rank_pvalue(real: DataFrame, surrogate: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, p, g): the rank of the real score among the surrogates', and the relative gap to their median."""
    joined = surrogate.select(*keys, F.col("mase").alias("s")).join(real.select(*keys, F.col("mase").alias("r")), list(keys))
    return rank_members(joined, keys)


def rank_members(scores: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, p, g) of rows (keys, s, r): a surrogate's score beside the real one of its series."""
    held = scores.groupBy(*keys).agg(F.count("s").alias("k"), F.count_if(F.col("s") <= F.col("r")).alias("c"), F.median("s").alias("med"), F.first("r").alias("r"))
    return held.select(*keys, ((1 + F.col("c")) / (F.col("k") + 1)).alias("p"), ((F.col("med") - F.col("r")) / F.nullif(F.col("med"), F.lit(0.0))).alias("g"))


def benjamini_hochberg(tests: DataFrame, group: list[str], q: float = 0.10) -> DataFrame:
    """Adjusted p-values within each group, and which tests fire at ``q``; a null p has none and doesn't fire.

    The tests of a group are counted by p, and only the counts are ranked: rank p-values over K surrogates have K + 1 values,
    however many series a family has.
    """
    seen = tests.where(F.col("p").isNotNull()).groupBy(*group, "p").agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy(*group)
    up_to = by.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = seen.withColumns({"_m": F.sum("_c").over(by), "_rk": F.sum("_c").over(up_to)})
    least = F.min(F.col("p") * F.col("_m") / F.col("_rk")).over(by.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0))
    adjusted = ranked.select(*group, "p", F.least(F.lit(1.0), least).alias("p_adj"))
    return tests.join(adjusted, [*group, "p"], "left").withColumn("fires", F.coalesce(F.col("p_adj") <= q, F.lit(False))).select(*tests.columns, "p_adj", "fires")


def firing(tests: DataFrame, group: list[str], rate: float = 0.20, floor: float | None = None, families: tuple[str, ...] = ("iaaft", "block")) -> DataFrame:
    """Per group the firing rate and median effect of each family, and a verdict.

    Both families must fire at ``rate`` with a median effect above ``floor``; while no floor is set the verdict is undetermined.
    """
    held = tests.groupBy(*group).pivot("family", list(families)).agg(F.avg(F.col("fires").cast("double")).alias("rate"), F.median("g").alias("effect"))
    every = lambda f: [f(x) for x in families]
    fired = F.least(*every(lambda x: F.col(f"{x}_rate"))) >= rate
    if floor is None:
        verdict = F.lit("undetermined")
    else:
        verdict = F.when(fired & (F.least(*every(lambda x: F.col(f"{x}_effect"))) > floor), "fires").otherwise("silent")
    return held.withColumn("verdict", verdict)


def bootstrap_interval(scores: DataFrame, resamples: int = 2000, tail: float = 0.025, key: str = "sid", order: str = "window_index", value: str = "mase") -> DataFrame:
    """(key, lo, hi): percentiles of means over resamples drawn by the counter generator.

    A key's scores are one array, in order, and a draw is a place in it; so a resample is computed where it is exploded.
    """
    known = scores.where(F.col(value).isNotNull())
    held = known.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("_x"))
    each = held.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    drawn = F.transform(F.sequence(F.lit(0), F.size("_x") - 1), lambda j: F.get("_x", (derive_seed("bootstrap", F.col(key), F.col("_b"), j) % F.size("_x")).cast("int")))
    means = each.select(key, (F.aggregate(drawn, F.lit(0.0), lambda s, x: s + x) / F.size("_x")).alias("m"))
    return means.groupBy(key).agg(F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"))


def best_row(rows: DataFrame, group: list[str], by: Column) -> DataFrame:
    """The row of each group with the least absolute value of ``by``, the first by its other columns on a tie; nulls lose."""
    rest = [c for c in rows.columns if c not in group]
    size = F.abs(by)
    held = rows.groupBy(*group).agg(F.min(F.struct(size.isNull().alias("_none"), size.alias("_size"), *rest)).alias("_b"))
    return held.select(*group, *[F.col(f"_b.{c}").alias(c) for c in rest])
