"""Curator: a PySpark-native engine for preparing and auditing language-model training data."""

__version__ = "0.1.0"
