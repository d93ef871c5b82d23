"""Spark jobs for API-contract and code-impact analytics: DataFrames in, DataFrames out."""
