"""Spark-native search and processing of message and document archives."""

__version__ = "0.1.0"
