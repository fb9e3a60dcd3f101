"""Occasio: a PySpark-native engine for shopping-occasion analytics."""

__version__ = "0.1.0"
