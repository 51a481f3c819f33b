"""Spark-native response-diversity analytics."""

__version__ = "0.1.0"
