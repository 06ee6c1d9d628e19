"""Spark-native engine for bilingual regulation and glossary retrieval."""

__version__ = "0.1.0"
