"""Cadenza: a PySpark-native engine for time-coded conversation data."""
