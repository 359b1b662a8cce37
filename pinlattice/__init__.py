"""Spark-native analytics for empirical package-compatibility data."""

__version__ = "0.1.0"
