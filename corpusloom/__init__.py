"""Corpus analytics on Spark: gates, de-duplication, splits, sampling, text functions, reports and scoring."""

__version__ = "0.1.0"
