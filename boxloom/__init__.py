"""Spark-native analytics over tables of text regions on pages, for many books at once."""

__version__ = "0.1.0"
