"""Spark-native evidence retrieval engine."""
