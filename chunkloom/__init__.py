"""Spark-native document chunking, chunk scoring and retrieval preparation."""
