"""Scalar rules of the protocol as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ROOT_SEED, USABLE

# Points in a season by frequency name, and the old names of newer spellings.
SEASONS = {"S": 3600, "s": 3600, "T": 1440, "min": 1440, "H": 24, "h": 24, "D": 1, "W": 1, "M": 12, "ME": 12, "B": 5, "Q": 4, "QE": 4, "A": 1, "Y": 1, "YE": 1}
LEGACY = {"Y": "A", "YE": "A", "QE": "Q", "ME": "M", "h": "H", "min": "T", "s": "S", "us": "U"}


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def derive_seed(*parts: Column | str) -> Column:
    """A 32-bit seed from the root and the parts: eight hex digits of their SHA-256."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(ROOT_SEED), *cols), 256), 9, 8), 16, 10).cast("bigint")


def legacy_freq(freq: Column) -> Column:
    """The old one-letter spelling of a frequency, without its multiple and anchor."""
    bare = F.regexp_replace(F.split(freq, "-")[0], "[0-9]", "")
    return F.coalesce(_lookup(LEGACY, bare), bare)


def seasonality(freq: Column) -> Column:
    """Points in a season: the base unit's, divided by the multiple where that leaves no rest, else 1."""
    pattern = r"^(\d*)\s*([A-Za-z]+)"
    unit = F.regexp_extract(F.trim(freq), pattern, 2)
    multiple = F.coalesce(F.regexp_extract(F.trim(freq), pattern, 1).try_cast("int"), F.lit(1))
    base = F.coalesce(_lookup(SEASONS, unit), _lookup(SEASONS, F.substring(unit, 1, 1)), F.lit(1))
    return F.when(multiple == 1, base).when(F.try_mod(base, multiple) == 0, F.floor(base / F.nullif(multiple, F.lit(0)))).otherwise(1).cast("int")


def pinball(y: Column, yhat: Column, q: Column) -> Column:
    """Twice the quantile loss."""
    u = y - yhat
    return 2 * F.when(u >= 0, q * u).otherwise((q - 1) * u)


def n_windows(n: Column) -> Column:
    """Windows of the usable length that fit in ``n`` points."""
    return F.greatest(F.lit(0), n - USABLE + 1).cast("bigint")


def block_length(n: Column, m: Column) -> Column:
    """Cube root of the length, at least a season, at most the length."""
    return F.least(F.greatest(F.bround(F.pow(n, F.lit(1 / 3))).cast("bigint"), F.when(m > 1, m).otherwise(1).cast("bigint"), F.lit(1)), n.cast("bigint"))


def deviation_pct(ours: Column, ref: Column) -> Column:
    return 100 * (ours - ref) / F.nullif(ref, F.lit(0.0))


def deviation_band(n: Column) -> Column:
    """How far a sampled score of ``n`` series may lie from a published one, in percent."""
    return 2.5 + 3 * 18.5 / F.sqrt(F.greatest(n, F.lit(1)))


def gap_pct(real: Column, surrogate: Column) -> Column:
    return 100 * (surrogate - real) / F.nullif(surrogate, F.lit(0.0))


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.lit(1e-8))


def context_factor(context: Column, horizon: Column, trained: Column) -> Column:
    """By how much positions are stretched for a model trained on contexts of ``trained`` points; never below one."""
    return F.greatest(F.lit(1.0), (context + horizon) / trained)


def task_key(dataset: Column, freq: Column, term: Column) -> Column:
    return F.concat_ws("/", dataset, freq, term)


def parse_task_key(key: Column) -> Column:
    """(dataset, freq, term); a key of other than three parts raises."""
    parts = F.split(key, "/")
    ok = F.when(F.size(parts) == 3, True).otherwise(F.raise_error(F.concat(F.lit("not a task key: "), key)).cast("boolean"))
    return F.when(ok, F.struct(parts[0].alias("dataset"), parts[1].alias("freq"), parts[2].alias("term")))


#: Horizons by legacy frequency, for the short term.
HORIZONS = {"M": 12, "W": 8, "D": 30, "H": 48, "T": 48, "S": 60}
M4_HORIZONS = {"A": 6, "Q": 8, "M": 18, "W": 13, "D": 14, "H": 48}
TERMS = {"short": 1, "medium": 10, "long": 15}


def prediction_length(dataset: Column, freq: Column, term: Column) -> Column:
    """Steps to forecast; null where no table has the frequency."""
    legacy = legacy_freq(freq)
    return (F.when(dataset.startswith("m4"), _lookup(M4_HORIZONS, legacy)).otherwise(_lookup(HORIZONS, legacy)) * _lookup(TERMS, term)).cast("int")


def rolling_count(dataset: Column, min_length: Column, h: Column) -> Column:
    """Windows that a tenth of the shortest series allows, 1 to 20; one for m4."""
    return F.when(dataset.startswith("m4"), 1).otherwise(F.least(F.greatest(F.ceil(0.1 * min_length / h), F.lit(1)), F.lit(20))).cast("int")
