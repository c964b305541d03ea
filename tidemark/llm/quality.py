"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs
from .sample import fold, labelled

#: Labelled rows that the trees are fitted on, at most about.
SAMPLE_ROWS = 20_000

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "unique_words", "top_word", "unique_lines", "words_per_line", "longest_word",
    "upper", "lower", "digit", "high", "space", "end_marks", "commas", "exclaims", "symbols", "bars", "quotes", "angle",
)


def _classes() -> np.ndarray:
    """Which byte values each counted class has: one row per class."""
    groups = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), b" \t\n\r", b".?", b",;:", b"!", b"#$%&*@^~+=_\\/", b"|", b"\"'`()", b"<>{}[]"]
    out = np.zeros((len(groups), 256))
    for i, g in enumerate(groups):
        out[i, list(g)] = 1
    return out


_CLASSES = _classes()


def statistics(text: bytes) -> list[float]:
    """The features of one document, in the order of ``FEATURES``; a text without words has zeros for shares."""
    words, lines = text.split(), text.splitlines()
    n, w, k = len(text), max(1, len(words)), max(1, len(lines))
    counts = Counter(words)
    share = _CLASSES @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / max(1, n)
    letters = n - text.count(b" ") - text.count(b"\n")
    return [
        np.log1p(n), np.log1p(len(words)), letters / w, len(counts) / w, max(counts.values(), default=0) / w, len(set(lines)) / k,
        len(words) / k, max(map(len, counts), default=0), *share.tolist(),
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth in heap order, one row per tree."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows; all rows descend all trees together, a level at a time."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (len(f))]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss, grown by level over histograms of gradients; empty input gives even odds."""
    inner = 2**depth - 1
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(y) else []
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if len(y) else None
    feature, threshold, value = [], [], []
    raw = np.full(len(y), base)
    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = at - first
            gain_best, choice = np.full(width, 1e-6), [None] * width
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                m = len(e) + 1
                key = slot * m + binned[:, j]
                g = np.cumsum(np.bincount(key, grad, width * m).reshape(width, m), 1)
                h = np.cumsum(np.bincount(key, hess, width * m).reshape(width, m), 1)
                gl, hl, ga, ha = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                gain[(hl < least) | (ha - hl < least)] = 0
                best = gain.argmax(1)
                top = gain[np.arange(width), best]
                for s in np.flatnonzero(top > gain_best):
                    gain_best[s], choice[s] = top[s], (j, best[s])
            cut = np.full(width, 1 << 30)
            use = np.zeros(width, np.int64)
            for s, c in enumerate(choice):
                if c is not None:
                    f[first + s], t[first + s] = c[0], edges[c[0]][c[1]]
                    use[s], cut[s] = c
            at = 2 * at + 1 + (binned[np.arange(len(y)), use[slot]] > cut[slot])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        v = -rate * g / (h + l2)
        raw += v[leaf]
        feature.append(f)
        threshold.append(t)
        value.append(v)
    shape = lambda rows, n, kind: np.array(rows, kind).reshape(len(rows), n)
    return Trees(shape(feature, inner, np.int64), shape(threshold, inner, float), shape(value, inner + 1, float), base, depth)


def _features(stream: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in stream:
        rows = [statistics(x) for x in blobs(batch.column(1))]
        yield batch, np.array(rows, float).reshape(len(rows), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = SAMPLE_ROWS, label: str = "quality") -> Trees:
    """Fit on about ``rows`` labelled documents outside the fold ``held``; only their statistics reach the driver."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _features(stream):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "label"])

    known = labelled(docs, labels, label, fold(F.col("doc_id"), folds) != held, rows)
    found = known.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, x array<double>, label int").toPandas().sort_values("doc_id")
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return fit(x, found["label"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= ``threshold``).

    Scores come from the text alone. Null texts count as empty and are scored like any text. Without a usable label
    every score is the even one, 0.5. Rows that repeat an id are scored each; extra columns are ignored.
    """
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, folds, held, rows)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _features(stream):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``threshold``.

    Every row is judged by its own text, as ``classify`` does: null counts as empty, ids and repeated rows play no part. An
    empty sample gives every row the score 0.5; no rows give no rows.
    """
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, folds, held, rows)
    at = docs.columns.index(text_col)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = [statistics(x) for x in blobs(batch.column(at))]
            if rows:
                yield batch.filter(pa.array(model.score(np.array(rows, float)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
