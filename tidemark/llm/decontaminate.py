"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask keeps some token positions of a window and ignores the others, so a seed survives substitutions at the
ignored ones. Windows of documents and of benchmark items are hashed under every mask and joined; each hit
fixes how an item lies over a document. There the tokens are compared one by one: an agreement counts 1, a
substitution costs ``penalty``, and the best run of them is the overlap. An item shorter than a mask is found as a
whole.

Only a text's hash, a position and a seed go through the join. The tokens come back for texts that were hit, and the
comparison is made on each such row's own tokens, so equal hashes of different texts cost time and change no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, cut

#: Masks over eight tokens, six kept: any two substitutions at least three tokens apart leave a seed of one of them whole.
MASKS = ("11101101", "11011011", "10110111")
#: More masks for items of at most ``SHORT`` tokens, which have few windows: with them any one or two substitutions
#: that leave eight tenths of an item of eight tokens or more leave a seed of it whole, at either end of a text too.
MORE_MASKS = ("111111", "1111011", "11100111", "11010111", "10111011", "11101011", "11110011")
SHORT = 16
#: Seeds of the benchmark, hit texts or lays up to which they are sent to every task (about 40 bytes each); beyond, both
#: sides of the join are shuffled.
BROADCAST_SEEDS = 500_000


def _tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda x: F.xxhash64(x))


def _seeds(held: DataFrame, keys: list[str], masks: list[str]) -> DataFrame:
    """The ``keys`` with pos and seed for every window of the tokens ``h`` under every mask that lies within them."""
    span = max(map(len, masks))
    padded = F.concat("h", F.array_repeat(F.lit(None).cast("long"), span - 1))
    shifted = F.arrays_zip(*[F.slice(padded, i + 1, F.size("h")).alias(f"t{i}") for i in range(span)])
    rows = held.select(*keys, F.posexplode(shifted).alias("pos", "w"))
    kept = [F.when(F.col(f"w.t{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(m), *[F.col(f"w.t{i}") for i in range(len(m)) if m[i] == "1"])) for m in masks]
    return rows.select(*keys, "pos", F.explode(F.array(*kept)).alias("seed")).where("seed IS NOT NULL")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked to be sent to every task if it has at most ``rows`` rows; it should be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _compared(part: Column, theirs: Column, penalty: int) -> Column:
    """Of two token runs of one length: best (the best run of agreements less penalties) and same (agreements)."""
    scores = F.zip_with(part, theirs, lambda x, y: F.when(x == y, 1).otherwise(-penalty))

    def step(s: Column, x: Column) -> Column:
        now = F.greatest(s["now"], F.lit(0)) + x
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"), (s["same"] + F.when(x > 0, 1).otherwise(0)).alias("same"))

    return F.aggregate(scores, F.struct(*[F.lit(0).alias(k) for k in ("now", "best", "same")]), step)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, item_n, item_h): items of equal tokens are one, those without tokens none."""
    items = benchmark.select(F.col(item_col).alias("item_id"), _tokens(F.col(text_col)).alias("item_h"))
    items = items.groupBy("item_h").agg(F.min("item_id").alias("item_id")).where(F.size("item_h") > 0)
    return cut(items.select("item_id", F.size("item_h").alias("item_n"), "item_h"))


def _overlaps(rows: DataFrame, keep: list[str], items: DataFrame, masks: tuple[str, ...], min_overlap: int, penalty: int, share: float, broadcast_seeds: int) -> DataFrame:
    """(``keep``, item_id, overlap) for each lay of an item over a row of ``rows`` (``keep``, text) that is an overlap."""
    span = len(masks[0])
    held = items.withColumnRenamed("item_h", "h")
    short = sorted(r.item_n for r in items.where(F.col("item_n") < span).select("item_n").distinct().collect())
    few = (F.col("item_n") >= span) & (F.col("item_n") <= SHORT)
    extra = list(MORE_MASKS) if masks == MASKS and not items.where(few).isEmpty() else []
    seeds = _seeds(held.where(F.col("item_n") >= span), ["item_id", "item_n"], list(masks))
    if extra:
        seeds = seeds.union(_seeds(held.where(few), ["item_id", "item_n"], extra))
    for n in short:
        seeds = seeds.union(_seeds(held.where(F.col("item_n") == n), ["item_id", "item_n"], ["1" * n]))
    seeds = cut(seeds.select("item_id", "item_n", F.col("pos").alias("item_pos"), "seed"))
    keyed = rows.withColumn("key", F.xxhash64("text"))
    windows = _seeds(keyed.select("key", _tokens(F.col("text")).alias("h")), ["key"], [*masks, *extra, *("1" * n for n in short)])
    at = (F.col("pos") - F.col("item_pos")).alias("at")
    # an item has no more tokens than seeds, but for a few at its end, so the count bounds both
    sent = F.broadcast if seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds else (lambda df: df)
    laid = cut(windows.join(sent(seeds), "seed").select("key", "item_id", at).distinct())
    hit = keyed.join(_bounded(cut(laid.select("key").distinct()), broadcast_seeds), "key", "left_semi").select(*keep, "key", _tokens(F.col("text")).alias("h"))
    both = hit.join(_bounded(laid, broadcast_seeds), "key").join(sent(items), "item_id")
    part = F.slice("h", F.greatest("at", F.lit(0)) + 1, F.col("item_n") + F.least("at", F.lit(0)))
    both = both.select(*keep, "item_id", "item_n", "item_h", "at", part.alias("part"))
    theirs = F.slice("item_h", F.greatest(-F.col("at"), F.lit(0)) + 1, F.size("part"))
    found = both.select(*keep, "item_id", "item_n", _compared(F.col("part"), theirs, penalty).alias("found"))
    same, best = F.col("found.same"), F.col("found.best")
    long_enough = best >= F.least(F.lit(min_overlap), F.ceil(F.col("item_n") * 0.9))
    almost_whole = same >= F.ceil(F.col("item_n") * F.lit(str(share)).cast("decimal(9,6)"))
    found = found.where(F.when(F.col("item_n") < span, same == F.col("item_n")).otherwise(long_enough | almost_whole))
    return found.select(*keep, "item_id", best.cast("long").alias("overlap"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS, min_overlap: int = 13, penalty: int = 3, share: float = 0.8, broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """(doc_id, item_id, overlap) for each document and benchmark item that overlap by ``min_overlap`` or more, or almost whole.

    ``overlap`` is the best run of aligned tokens, agreements less ``penalty`` per substitution; an item shorter
    than ``min_overlap`` tokens must be there with nine tenths of its length. An item is there almost whole if ``share``
    of its tokens agree where it lies, whatever the penalties. Items of fewer tokens than a mask is long must be there
    whole, in a row. Items of equal tokens are one, under their smallest id.
    Null texts are empty and overlap nothing; null ids are ids like any other; rows that repeat an id are judged
    each, and the best overlap counts. Texts may be of any length; extra columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = _overlaps(rows, ["doc_id"], _items(benchmark, item_col, item_text_col), masks, min_overlap, penalty, share, broadcast_seeds)
    return found.groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS, min_overlap: int = 13, penalty: int = 3, share: float = 0.8, broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that overlap no benchmark item as ``contaminated`` has it.

    A row is judged by its own text, so one that shares its id, or the lack of one, with a leaked row stays. Null and
    empty texts stay, and so do all rows if the benchmark is empty. Rows that repeat a text share its fate.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.sha2(text, 256).alias("digest"), text.alias("text"))
    found = _overlaps(rows, ["digest"], _items(benchmark, item_col, item_text_col), masks, min_overlap, penalty, share, broadcast_seeds)
    gone = cut(found.select(F.col("digest").alias("_gone")).distinct())
    return docs.join(_bounded(gone, BROADCAST_IDS), F.sha2(text, 256) == F.col("_gone"), "left_anti")
