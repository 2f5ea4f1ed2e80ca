"""Spark-native engine for annotated-image datasets and similar event-sourced data."""

__version__ = "0.1.0"
