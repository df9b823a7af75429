"""Spark-native retrieval, evaluation and text-analytics operators."""
