"""Tidemark: valid-time tables, temporal merge and history on plain Spark DataFrames."""

__version__ = "0.1.0"
