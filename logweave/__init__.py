"""Spark-native analytics over append-only, semi-structured session logs."""

__version__ = "0.1.0"
