"""Toxicity by maximum-scoring segments.

Every token scores its log-odds between toxic and clean text under an informative Dirichlet prior, drawn toward zero as
far as chance may explain them, less a constant drift that makes clean text lose. One linear scan finds every maximal scoring segment of a document.
Chance segments follow an extreme-value law whose decay solves E[exp(lambda s)] = 1 over clean tokens; the number
of them that a text of its length would show by chance makes each segment's weight.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, texts
from .sample import fold, labelled

#: Labelled rows that log-odds are learned from, at most about.
SAMPLE_ROWS = 40_000
#: Leading letters that stand for a word too: languages inflect, so one stem has many forms.
STEMS = (4, 5, 6)
_EDGES = "\"'`.,;:!?()[]{}<>|*#$%&@^~+=_-\\/«»“”„¿¡…"


def _sketch(text: Column) -> Column:
    """The least hash of four consecutive words, which near copies mostly share; of the whole text if it is shorter."""
    h = F.transform(F.split(F.lower(text), r"\s+"), lambda x: F.xxhash64(x))
    n = F.greatest(F.size(h) - 3, F.lit(0))
    two = lambda i: F.zip_with(F.slice(h, i, n), F.slice(h, i + 1, n), lambda x, y: F.xxhash64(x, y))
    return F.coalesce(F.array_min(F.zip_with(two(1), two(3), lambda x, y: F.xxhash64(x, y))), F.xxhash64(text))


def _units(word: str) -> list[str]:
    """What a word is known by: itself, marked, and its longer stems."""
    return ["=" + word, *(word[:k] for k in STEMS if len(word) > k)]


@dataclass
class Model:
    """Log-odds of units, for or against; the drift of every token; the two constants of the extreme-value law."""

    odds: dict[str, float]
    loss: float = -0.5
    decay: float = 1.0
    rate: float = 1.0
    words: dict = field(default_factory=dict, repr=False)

    def token(self, word: str) -> float:
        """The strongest evidence among a word and its stems, and the drift."""
        found = [x for x in map(self.odds.get, _units(word.strip(_EDGES))) if x is not None]
        return max(found, key=abs, default=0.0) + self.loss

    def scores(self, text: str) -> np.ndarray:
        if len(self.words) > 400_000:
            self.words.clear()
        known, words = self.words, text.lower().split()
        for w in words:
            if w not in known:
                known[w] = self.token(w)
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score), by the linear scan over left and right totals.

    Losses between gains are taken together, so the scan visits gains only.
    """
    gains = np.flatnonzero(scores > 0)
    if not len(gains):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    held: list[list] = []  # start, end, total before, total after, nearest earlier candidate with a smaller total before
    for i in gains.tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append([start, end, left, right, j])
                break
            start, left = held[j][0], held[j][2]
            del held[j:]
    return [(s, e, float(r - lf)) for s, e, lf, r, _ in held]


def chance(model: Model, n: int, segments: list[tuple[int, int, float]]) -> list[float]:
    """For each segment, how many as good a clean text of ``n`` tokens is expected to have."""
    return [model.rate * n * float(np.exp(-model.decay * s)) for _, _, s in segments]


def score(model: Model, text: str) -> float:
    """1 - product over segments of the chance that it is none: 0 without gains, near 1 with a sure passage."""
    s = model.scores(text)
    segments = maximal_segments(s)
    rest = 1.0
    for e in chance(model, len(s), segments):
        rest *= 1 - np.exp(-e)
    return float(1 - rest)


def passages(model: Model, text: str, most_by_chance: float = 0.05) -> list[tuple[int, int, float]]:
    """The significant segments of a text as (first token, token after the last, score)."""
    s = model.scores(text)
    found = maximal_segments(s)
    return [x for x, e in zip(found, chance(model, len(s), found), strict=True) if e <= most_by_chance]


def log_odds(counts: DataFrame, prior: float = 10.0, sure: float = 4.2) -> DataFrame:
    """(u, s) from (u, y1, y0), how many toxic and clean documents have each unit: its shrunk log-odds where they aren't zero.

    Each kind is a multinomial over units with a Dirichlet prior of ``prior`` pseudo-counts spread as both kinds
    together are. The log-odds keep the part 1 - (sure / z)^2, with z the signed root of the likelihood ratio against one share
    for both kinds, which is fair to small counts too; within ``sure`` deviations nothing is left of them.
    """
    total = counts.agg(F.sum("y1").alias("n1"), F.sum("y0").alias("n0"))
    y1, y0, n1, n0 = (F.col(c).cast("double") for c in ("y1", "y0", "n1", "n0"))
    share = (y1 + y0) / (n1 + n0)
    a1, a0 = y1 + prior * share, y0 + prior * share
    delta = F.log(a1 / (n1 + prior - a1)) - F.log(a0 / (n0 + prior - a0))

    def term(y: Column, n: Column) -> Column:
        rest = n - y
        return F.when(y > 0, y * F.log(y / (n * share))).otherwise(0.0) + F.when(rest > 0, rest * F.log(rest / (n * (1 - share)))).otherwise(0.0)

    square = 2 * (term(y1, n1) + term(y0, n0))
    held = counts.join(F.broadcast(total)).where((n1 > 0) & (n0 > 0) & (share < 1))
    return held.select("u", square.alias("square"), delta.alias("delta")).where(F.col("square") > sure**2).select("u", (F.col("delta") * (1 - sure**2 / F.col("square"))).alias("s"))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, rows: int = SAMPLE_ROWS, label: str = "toxic", prior: float = 10.0, sure: float = 4.2, loss: float = -1.0) -> Model:
    """Learn from about ``rows`` labelled documents outside the fold ``held``.

    Counting runs on the executors, by documents that have a unit, so that one repetitive document can't make
    evidence, and of near copies (equal least hash of four words) one counts. The driver gets the units whose log-odds
    are more than chance, all of them; the rest score as unknown words do.
    """
    known = labelled(docs, labels, label, fold(F.col("doc_id"), folds) != held, rows, by_label=True).where(F.col("label").isin(0, 1))
    first = known.groupBy(_sketch(F.col("text")).alias("sketch")).agg(F.min(F.struct("doc_id", "label", "text")).alias("first"))
    known = cut(first.select("first.label", "first.text"))

    def counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def sent() -> Iterator[pa.RecordBatch]:
            for kind, found in enumerate(seen):
                names = list(found)
                for i in range(0, len(names), 50_000):
                    part = names[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([kind] * len(part), pa.int32()), pa.array([found[k] for k in part], pa.int64())], names=["u", "kind", "n"])
                found.clear()

        for batch in stream:
            for kind, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                seen[kind].update({u for w in {w.strip(_EDGES) for w in t.lower().split()} if w for u in _units(w)})
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield from sent()
        yield from sent()

    by_unit = known.select("label", "text").mapInArrow(counted, "u string, kind int, n long").groupBy("u")
    counts = cut(by_unit.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"y{k}") for k in (1, 0)]))
    found = log_odds(counts, prior, sure).toPandas()
    model = Model(dict(zip(found["u"].tolist(), found["s"].tolist(), strict=True)), loss)
    if not any(s + loss > 0 for s in model.odds.values()):
        return model

    def law(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of clean texts: tokens and best segment of each (many = 0), and how many tokens have each score."""
        for batch in stream:
            rows, values = [], Counter()
            for t in texts(batch.column(0)):
                s = model.scores(t)
                rows.append((0, float(len(s)), max((x[2] for x in maximal_segments(s)), default=0.0)))
                values.update(s.tolist())
            rows += [(n, 0.0, v) for v, n in values.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["many", "n", "s"])

    seen = known.where("label = 0").select("text").mapInArrow(law, "many long, n double, s double").toPandas()
    values = seen[seen["many"] > 0].groupby("s")["many"].sum()
    # gains that clean tokens never showed count half a token
    gains = np.unique(np.concatenate([values.index.to_numpy(float), np.array(list(model.odds.values()), float) + loss]))
    often = np.maximum(values.reindex(gains, fill_value=0).to_numpy(float), 0.5)
    often /= often.sum()
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (often * np.exp(mid * gains)).sum() > 1 else (mid, high)
    model.decay = low
    each = seen[seen["many"] == 0]
    held_by_chance = float((each["n"] * np.exp(-low * each["s"])).sum())
    model.rate = len(each) / held_by_chance if held_by_chance else 1.0
    return model


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted, n_passages.

    Scores come from the text alone; null and empty texts score 0. Without labels of both kinds all score 0. Rows
    that repeat an id are scored each; extra columns are ignored.
    """
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, folds, held, rows)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out, many = [], []
            for t in texts(batch.column(1)):
                s = model.scores(t)
                e = np.array(chance(model, len(s), maximal_segments(s)))
                out.append(float(1 - np.prod(1 - np.exp(-e))))
                many.append(int((e <= 0.05).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(many, pa.int64())], names=["doc_id", "score", "n_passages"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_passages long")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")
