"""Ordwell: a PySpark-native engine for noisy, ordered observations of matches."""
