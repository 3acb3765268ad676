"""Spark-native analytics over support conversations."""
