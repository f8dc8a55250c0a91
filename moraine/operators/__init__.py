"""DataFrame operators: DataFrames in, DataFrames out, refusals as rows with NULL numbers."""
