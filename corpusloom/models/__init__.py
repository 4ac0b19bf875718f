"""Models as protocols, and the adapters that run them over DataFrames in Arrow batches."""
