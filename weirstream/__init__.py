"""Spark-native analytics for adaptive-streaming catalogs."""
