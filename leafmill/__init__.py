"""Spark-native indexing and search of text collections."""

__version__ = "0.1.0"
