"""Tidewater: a PySpark-native engine for analytics, replicated state and training-data work."""

__version__ = "0.1.0"
