"""Spark-native analytics for tool-building rollouts: datasets, parsing, verification, rewards, metrics."""
