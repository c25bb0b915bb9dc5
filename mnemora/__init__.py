"""Spark-native engine for querying and processing a mirror of personal data."""
