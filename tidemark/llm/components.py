"""Connected components by alternating large-star and small-star steps, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def meet(rows: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """``rows`` joined on ``key`` with an aggregate that has one row per key.

    Both sides are dealt out anew, by the key's hash and the key: an aggregate's own exchange is no plain one, and
    only plain exchanges on both sides are split by adaptive execution where a key has very many rows.
    """
    dealt = lambda df: df.withColumn("_dealt", F.xxhash64(key))
    return dealt(rows).join(dealt(least), ["_dealt", key]).drop("_dealt")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = meet(both, least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
        out = meet(edges, least, "a").select(F.explode(ends).alias("e")).select("e.a", "e.b")
    return out.where("a > b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the smallest node reachable.

    Loops and repeated edges do no harm; rows with a null end are ignored. Every round is cut in the shared
    folder. It ends when a round changes no edge, which takes a number of rounds of the order of the logarithm
    of the largest component; running past ``max_rounds`` raises.
    """
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct())
    sign = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (seen.n, seen.s) == sign or not seen.n:
            break
        sign = (seen.n, seen.s)
        now = cut(_star(_star(now, True), False))
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
