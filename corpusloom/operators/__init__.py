"""Operators on DataFrames: gates, de-duplication, splits, sampling, joins, reports, selection."""
