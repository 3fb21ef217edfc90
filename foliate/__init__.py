"""Spark-native engine for hierarchical document collections and training corpora."""
