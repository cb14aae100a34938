"""Spark-native candidate retrieval, reranking and evaluation operators."""
