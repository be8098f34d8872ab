"""Tidemark: a Spark engine for staged research on panels of prices, and for training-data corpora."""

__version__ = "0.1.0"
