"""Spark-native analytics over timelines of described events."""
