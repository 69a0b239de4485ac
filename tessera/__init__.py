"""Tessera: a PySpark-native engine for building and auditing geometry-problem datasets."""

__version__ = "0.2.0"
