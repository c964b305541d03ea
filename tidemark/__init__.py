"""Spark-native evaluation and provenance analytics for large collections of time series."""

__version__ = "0.1.0"
