"""Spark-native similarity search, retrieval analytics and corpus operators."""
