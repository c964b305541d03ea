"""Every query by name, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import score_queries, series_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = series_queries.QUERIES
ORACLES: dict[str, str] = series_queries.ORACLES
flagship = score_queries.flagship
