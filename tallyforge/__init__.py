"""Spark-native analytics over select-project-join counts and their statistics."""
