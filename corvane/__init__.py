"""Corvane: a PySpark-native context-retrieval and data-processing engine."""

__version__ = "0.1.0"
