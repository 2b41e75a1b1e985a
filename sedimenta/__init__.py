"""Spark-native hybrid retrieval, indexing and incremental processing engine."""

__version__ = "0.1.0"
