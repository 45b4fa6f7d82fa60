"""Threadlens: a PySpark-native analytics engine for discussion-page histories."""

__version__ = "0.1.0"
