"""Spark-native analytics for competition and betting-market data."""

__version__ = "0.1.0"
