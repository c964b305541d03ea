"""Reference forecasts, and the contract by which others come in as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _past(split: DataFrame, keys: list[str]) -> DataFrame:
    whole = Window.partitionBy(*keys)
    return split.where("part = 'past'").withColumn("n", F.count(F.lit(1)).over(whole))


def seasonal_naive(split: DataFrame, h: int, m: Column | int, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, step, yhat): the last season repeated; the last value where the past is shorter than a season."""
    p = _past(split, list(keys)).withColumn("m", m if isinstance(m, Column) else F.lit(m))
    whole = F.col("n") >= F.col("m")
    first = F.when(whole, F.col("step") - (F.col("n") - F.col("m"))).otherwise(F.lit(0)).cast("bigint")
    stride = F.when(whole, F.col("m")).otherwise(1).cast("bigint")
    used = p.where((whole & (F.col("step") >= F.col("n") - F.col("m"))) | (~whole & (F.col("step") == F.col("n") - 1)))
    used = used.withColumns({"first": first, "stride": stride}).where(F.col("first") < h)
    return used.select(*keys, F.explode(F.sequence(F.col("first"), F.lit(h - 1).cast("bigint"), F.col("stride"))).alias("step"), F.col("v").alias("yhat"))


def quantiles(points: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """A point forecast at every level."""
    return points.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in levels])))


def seasonal_average(split: DataFrame, h: int, m: int, cycles: int = 4, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, step, yhat): the mean of the last ``cycles`` values of the same phase; needs that many full seasons."""
    p = _past(split, list(keys)).where((F.col("n") >= cycles * m) & (F.col("step") >= F.col("n") - cycles * m))
    phase = p.groupBy(*keys, ((F.col("step") - (F.col("n") - cycles * m)) % m).alias("phase")).agg(F.avg("v").alias("yhat"))
    return phase.where(F.col("phase") < h).select(*keys, F.explode(F.sequence(F.col("phase").cast("bigint"), F.lit(h - 1).cast("bigint"), F.lit(m).cast("bigint"))).alias("step"), "yhat")


Forecaster = Callable[[np.ndarray, int, int], np.ndarray]


def harmonic(past: np.ndarray, h: int, m: int, pairs: int = 8) -> np.ndarray:
    """Least squares on level, trend and sine-cosine pairs of the season, of least norm where columns coincide."""
    t = np.arange(len(past) + h, dtype=float)
    waves = [f(2 * np.pi * k * t / max(m, 1)) for k in range(1, pairs + 1) for f in (np.sin, np.cos)]
    x = np.stack([np.ones_like(t), t / max(1, len(past)), *waves], 1)
    return x[len(past) :] @ np.linalg.lstsq(x[: len(past)], past, rcond=None)[0]


def autoregressive(past: np.ndarray, h: int, m: int) -> np.ndarray:
    """Least squares on the last m values with a level, rolled forward; m is cut to a third of the past."""
    p = max(1, min(m, len(past) // 3))
    if len(past) < 4:
        return np.repeat(past[-1], h)
    x = np.stack([past[p - k - 1 : len(past) - k - 1] for k in range(p)] + [np.ones(len(past) - p)], 1)
    w = np.linalg.lstsq(x, past[p:], rcond=None)[0]
    held = past.tolist()
    for _ in range(h):
        held.append(float(np.dot(w[:-1], held[-1 : -p - 1 : -1]) + w[-1]))
    return np.array(held[len(past) :])


def smoothed(past: np.ndarray, h: int, m: int) -> np.ndarray:
    """Simple exponential smoothing with the rate of least one-step error on a grid of twenty."""
    best, level_best = np.inf, past[-1]
    for a in np.linspace(0.05, 1, 20):
        level, cost = past[0], 0.0
        for v in past[1:]:
            cost += (v - level) ** 2
            level += a * (v - level)
        if cost < best:
            best, level_best = cost, level
    return np.repeat(level_best, h)


def theta(past: np.ndarray, h: int, m: int) -> np.ndarray:
    """Smoothing plus half the linear trend, on data seasonally adjusted by phase means where two seasons are there."""
    n = len(past)
    season = np.zeros(max(m, 1))
    if m > 1 and n >= 2 * m:
        season = np.array([past[k::m].mean() for k in range(m)]) - past.mean()
    flat = past - season[np.arange(n) % len(season)]
    slope = np.polyfit(np.arange(n), flat, 1)[0] if n > 1 else 0.0
    return smoothed(flat, h, m) + slope / 2 * np.arange(1, h + 1) + season[np.arange(n, n + h) % len(season)]


FORECASTERS: dict[str, Forecaster] = {"harmonic": harmonic, "ar": autoregressive, "ses": smoothed, "theta": theta}


def apply_forecaster(windows: DataFrame, forecaster: Forecaster, h: int, m: int, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, step, yhat) from windows with an array ``past``, by a function in Python; windows with holes are left out."""
    kinds = dict(windows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                past = np.array(row[-1], float)
                if len(past) and np.isfinite(past).all():
                    out += [(*row[:-1], s, float(y)) for s, y in enumerate(forecaster(past, h, m))]
            yield pd.DataFrame(out, columns=[*keys, "step", "yhat"])

    return windows.select(*keys, "past").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", step long, yhat double")


def cached(wanted: DataFrame, cache: DataFrame, keys: tuple[str, ...] = ("revision", "content_hash", "window_id", "seed")) -> DataFrame:
    """Windows that the table of known forecasts doesn't have yet."""
    return wanted.join(cache.select(*keys).distinct(), list(keys), "left_anti")


def import_forecasts(forecasts: DataFrame, windows: DataFrame, h: int, keys: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """Forecasts made elsewhere; a window whose number of steps isn't ``h`` raises rather than scoring in part."""
    sizes = forecasts.groupBy(*keys).agg(F.countDistinct("step").alias("steps"))
    ok = windows.select(*keys).join(sizes, list(keys), "left")
    good = F.when(F.col("steps") == h, True).otherwise(F.raise_error(F.lit(f"a window has not {h} forecast steps")).cast("boolean"))
    return forecasts.join(ok.where(good).select(*keys), list(keys))


def frozen_inputs(windows: DataFrame, errors: DataFrame, context: int, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """What an outside model gets: the last ``context`` values as floats, the target, and the error of the full past."""
    return windows.join(errors, list(keys)).select(
        *keys, F.transform(F.slice("past", F.greatest(F.size("past") - context + 1, F.lit(1)), context), lambda x: x.cast("float")).alias("context"),
        "target", F.size("target").cast("bigint").alias("horizon"), F.col("err").alias("seasonal_error"),
    )


QuantileForecaster = Callable[[list[np.ndarray], int, list[float], int], np.ndarray]


def apply_quantile_forecaster(windows: DataFrame, load: Callable[[], QuantileForecaster], h: int, levels: list[float], batch: int = 32, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, step, q, yhat) from a model that forecasts quantiles for a batch of pasts.

    ``load`` runs once per task and returns (pasts, h, levels, seed) -> array (pasts, h, levels); ``windows`` has
    the keys, ``past`` and ``seed``. The seed of a batch is that of its first window, so order the windows if
    results must repeat.
    """
    kinds = dict(windows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                out = np.asarray(model([np.array(x, float) for x in part["past"]], h, levels, int(part["seed"].iloc[0])))
                grid = pd.MultiIndex.from_product([range(len(part)), range(h), levels], names=["i", "step", "q"]).to_frame(index=False)
                found = part[list(keys)].iloc[grid["i"]].reset_index(drop=True)
                yield found.assign(step=grid["step"], q=grid["q"], yhat=out.reshape(-1))

    return windows.select(*keys, "past", "seed").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", step long, q double, yhat double")
