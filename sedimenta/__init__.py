"""Sedimenta: a PySpark-native engine for layered document and relational data."""

__version__ = "0.1.0"
