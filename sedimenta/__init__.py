"""Sedimenta: a Spark-native engine for append-only event and knowledge logs."""

__version__ = "0.1.0"
