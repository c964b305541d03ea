"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to order three with frozen counts, over all 256 byte values. A byte costs
its code length in the longest context that the tree has: -log2 n / (N + D) if it was seen there, else that of an
escape, D / (N + D), and what the next shorter context charges; below order zero every byte has eight bits. A level of
a tree is a sorted array of byte runs with their counts, so the distinct runs of a block of texts are priced together
by binary search, and no context is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs
from .sample import _STEPS, fold

#: Documents per language that the trees are counted on, about.
SAMPLE_ROWS = 500
#: Bytes of text that are priced at a time.
BLOCK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_GAP = b"\n\n\n"


@dataclass
class Trees:
    """Counts of four-byte runs per language, as sorted codes; ``table`` prepares them for coding."""

    langs: list[str]
    codes: list[np.ndarray]
    counts: list[np.ndarray]

    def table(self) -> Table:
        """The levels of all trees, built once in a process for the same counts."""
        parts = [repr(self.langs).encode(), *(x.tobytes() for x in (*self.codes, *self.counts))]
        key = hashlib.sha256(b"|".join(parts)).hexdigest()
        if key not in _tables:
            _tables.clear()
            _tables[key] = Table(self)
        return _tables[key]


_tables: dict[str, Table] = {}


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sum of ``n`` for each."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, n, len(found))


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key among the sorted ones, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class _Level:
    """One order of one tree: what a run seen there costs, and what an escape from each context costs."""

    def __init__(self, code: np.ndarray, n: np.ndarray, order: int) -> None:
        self.keep = (1 << 8 * (order + 1)) - 1
        self.code, n = _summed(code & self.keep, n)
        self.context, total = _summed(self.code >> 8, n)
        at = np.searchsorted(self.context, self.code >> 8)
        kinds = np.bincount(at, minlength=len(self.context))
        base = total + kinds
        self.seen, self.escape = np.log2(base[at]) - np.log2(n), np.log2(base) - np.log2(kinds)


class Table:
    def __init__(self, trees: Trees) -> None:
        self.levels = [[_Level(c.astype(np.int64), n.astype(float), order) for order in (3, 2, 1, 0)] for c, n in zip(trees.codes, trees.counts, strict=True)]

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four-byte run after its first three, a column per language."""
        out = np.zeros((len(code), max(1, len(self.levels))))
        for k, levels in enumerate(self.levels):
            left, now = np.arange(len(code)), code
            for level in levels:
                at, there = _find(level.code, now & level.keep)
                out[left[there], k] += level.seen[at[there]]
                left, now = left[~there], now[~there]
                at, known = _find(level.context, (now & level.keep) >> 8)
                out[left[known], k] += level.escape[at[known]]
            out[left, k] += 8
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits, a row per text and a column per language."""
        out = np.zeros((len(texts), max(1, len(self.levels))))
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if len(t) > BLOCK:
                for k in range(0, len(t), BLOCK):
                    out[i] += self._code([t[k : k + BLOCK]], t[max(0, k - 3) : k])[0]
                continue
            group.append(i)
            size += len(t)
            if size > BLOCK:
                out[group] = self._code([texts[j] for j in group])
                group, size = [], 0
        if group:
            out[group] = self._code([texts[j] for j in group])
        return out

    def _code(self, texts: list[bytes], before: bytes = b"") -> np.ndarray:
        out = np.zeros((len(texts), max(1, len(self.levels))))
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        b = np.frombuffer(before.rjust(3, b"\n") + _GAP.join(texts[i] for i in full), np.uint8).astype(np.uint32)
        code, at = np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], return_inverse=True)
        cost = self.costs(code.astype(np.int64))
        n = np.array([len(texts[i]) for i in full])
        start = np.concatenate(([0], np.cumsum(n + 3)[:-1]))
        cuts = np.stack([start, start + n], 1).ravel()[: 2 * len(full) - 1]
        for k in range(out.shape[1]):
            out[full, k] = np.add.reduceat(cost[at, k], cuts)[::2]
        return out


def _runs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of four-byte runs, the first ones of a text after three line ends."""
    for batch in stream:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            b = np.frombuffer(_GAP + _GAP.join(texts), np.uint8).astype(np.int64)
            code, n = np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


def train(docs: DataFrame, folds: int = 5, held: int = 0, rows: int = SAMPLE_ROWS) -> Trees:
    """Count about ``rows`` documents of each language outside the fold ``held``; every language that is a label is learned.

    ``docs`` has doc_id, text and lang. What reaches the driver is bounded by the number of languages times the
    distinct byte runs of ``rows`` documents.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    many = {r.lang: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(many)
    if not langs:
        return Trees([], [], [])
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, rows / many[k]) * _STEPS) + 1)])
    taken = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(_STEPS)) < share[F.col("lang")])
    found = taken.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(_runs, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    parts = [found[found["lang"] == k].sort_values("code") for k in langs]
    return Trees(langs, [p["code"].to_numpy(np.uint32) for p in parts], [p["n"].to_numpy(np.uint32) for p in parts])


def identify(docs: DataFrame, folds: int = 5, held: int = 0, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1), bits_per_byte.

    The language with the shortest code wins, the first by name on a tie; the score is its posterior under equal
    priors. A null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing could
    be learned. Rows that repeat an id are judged each; extra columns are ignored.
    """
    trees = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), folds, held, rows)
    langs = np.array([*trees.langs, "und"], object)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = trees.table() if trees.langs else None
        for batch in stream:
            texts = blobs(batch.column(1))
            found = np.full(len(texts), len(langs) - 1)
            sure, cost = np.zeros(len(texts)), np.zeros(len(texts))
            real = [i for i, t in enumerate(texts) if t and _LETTER.search(t.decode("utf-8", "replace"))] if table else []
            if real:
                bits = table.lengths([texts[i] for i in real])
                best = bits.argmin(1)
                least = bits[np.arange(len(real)), best]
                found[real] = best
                sure[real] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                cost[real] = least / np.array([len(texts[i]) for i in real])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs[found].tolist(), pa.string()), pa.array(sure), pa.array(cost)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    coded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")
    return coded.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score", "bits_per_byte")
