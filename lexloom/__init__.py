"""Spark-native analytics over comparative wordlists and text corpora."""
