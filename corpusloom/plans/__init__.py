"""Helpers that shape physical plans: skew-safe joins and bounded broadcasts; composite pipelines."""
