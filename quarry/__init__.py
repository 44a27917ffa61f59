"""A Spark-native knowledge and retrieval engine."""
