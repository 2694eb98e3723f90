"""Spark-native analytics over codebases and document collections."""
