"""Spark-native change-data journal engine."""

__version__ = "0.1.0"
