"""Spark-native analytics over text and source files, findings and training data."""
