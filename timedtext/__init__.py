"""Spark-native analytics over time-coded text."""
