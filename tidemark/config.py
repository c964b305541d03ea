"""Protocol constants and registries."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

#: Fixed value: the root of all derived seeds.
ROOT_SEED = "20260726"
CONTEXT, HORIZON = 512, 24
USABLE = CONTEXT + HORIZON
CUTOFF = date(2025, 1, 1)
LAG_DAYS = 7
LEVELS = tuple(i / 10 for i in range(1, 10))


@dataclass(frozen=True)
class Protocol:
    """What the evaluation protocol fixes in advance."""

    surrogates: int = 100
    families: tuple[str, ...] = ("iaaft", "block")
    fdr: float = 0.10
    firing: float = 0.20
    negative_control: float = 0.05
    resamples: int = 2000
    effect_floor: float | None = None


@dataclass(frozen=True)
class BacktestConfig:
    """One fixed-offset backtest: the last ``-offset`` points are held back and ``prediction_length`` are scored."""

    name: str
    offset: int
    prediction_length: int

    def __post_init__(self) -> None:
        if self.offset >= 0 or self.prediction_length <= 0:
            raise ValueError("offset must be negative and prediction_length positive")


@dataclass(frozen=True)
class SourceSpec:
    key: str
    domain: str
    freq: str
    token_env: str | None = None


SOURCES = {x.key: x for x in (SourceSpec("open_meteo", "weather", "H"), SourceSpec("wikipedia", "web", "D"), SourceSpec("entsoe", "electricity", "H", "ENTSOE_API_TOKEN"))}


@dataclass(frozen=True)
class ModelSpec:
    """A model under evaluation; ``context_cap`` is the longest input that it takes, none where any will do."""

    key: str
    repo: str
    released: date
    context_cap: int | None = None


#: The public models under evaluation.
MODELS = {
    x.key: x
    for x in (
        ModelSpec("chronos-base", "amazon/chronos-t5-base", date(2024, 3, 13), 512),
        ModelSpec("timesfm-200m", "google/timesfm-1.0-200m", date(2024, 5, 1), 512),
        ModelSpec("moirai-base", "Salesforce/moirai-1.0-R-base", date(2024, 3, 1)),
        ModelSpec("lag-llama", "time-series-foundation-models/Lag-Llama", date(2024, 2, 5)),
    )
}


def model(key: str) -> ModelSpec:
    """A registered model; an unknown key names those that are known."""
    if key not in MODELS:
        raise KeyError(f"{key} is none of {', '.join(MODELS)}")
    return MODELS[key]


def latest_release() -> date:
    """The last release among the registered models, before which no observation is fresh for all of them."""
    return max(x.released for x in MODELS.values())


def lock(resolve: Callable[[str], dict], now: str) -> dict:
    """The revisions that ``resolve`` (repository -> answer with ``sha``) gives; a failure is an entry without one."""

    def entry(spec: ModelSpec) -> dict:
        try:
            found = resolve(spec.repo)
            return {"repo_id": spec.repo, "revision": found["sha"], "last_modified": found.get("lastModified")}
        except Exception as e:  # one model that can't be resolved stops no other
            return {"repo_id": spec.repo, "revision": None, "error": f"{type(e).__name__}: {e}"[:200]}

    return {"schema_version": 1, "resolved_at_utc": now, "models": {k: entry(x) for k, x in MODELS.items()}}


def fetch_window(start: date, end: date | None = None, today: date | None = None) -> tuple[date, date]:
    """The window to fetch: no day before the cutoff, and no day so late that it may still change."""
    end = end or (today or date.today()) - timedelta(days=LAG_DAYS)
    if start < CUTOFF:
        raise ValueError(f"start {start} is before the cutoff {CUTOFF}")
    if end <= start:
        raise ValueError("empty window")
    return start, end


def available(key: str) -> bool:
    """Whether a source can be read here: it needs no token, or its token is set."""
    token = SOURCES[key].token_env
    return token is None or bool(os.environ.get(token))


def parse_dotenv(text: str) -> dict[str, str]:
    """NAME=value lines; comments, blank lines and an ``export`` in front are allowed, quotes come off."""
    out = {}
    for line in text.splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and name.strip() and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    return out


def load_dotenv(path: str) -> list[str]:
    """Set what the file has and the environment hasn't; the names set."""
    with open(path, encoding="utf-8") as f:
        found = parse_dotenv(f.read())
    fresh = [k for k in found if k not in os.environ]
    os.environ.update({k: found[k] for k in fresh})
    return fresh


def pinned_revision(lock: dict, key: str) -> str:
    """The revision a lock file pins for a model; an unpinned model is an error."""
    revision = (lock.get(key) or {}).get("revision")
    if not revision:
        raise RuntimeError(f"{key} has no pinned revision")
    return revision
