"""Granary: a Spark-native engine for data-quality analytics."""

__version__ = "0.1.0"
