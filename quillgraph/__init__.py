"""Quillgraph: a Spark-native engine for linked text collections."""

__version__ = "0.1.0"
