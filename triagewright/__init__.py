"""Test-failure triage on Spark: DataFrames in, DataFrames out."""
