"""Spark-native analytics for time series, vectors, sequences and text corpora."""

__version__ = "0.1.0"
