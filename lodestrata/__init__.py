"""Spark-native analytics for panels, events and training corpora."""

__version__ = "0.1.0"
