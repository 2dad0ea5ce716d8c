"""Readers of the sources' files: a path in, DataFrames out, through Spark's own readers."""
