"""The engine's operators: DataFrames in, DataFrames out."""
