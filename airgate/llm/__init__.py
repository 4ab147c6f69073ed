"""Operators that prepare a training corpus: DataFrames in, DataFrames out."""
