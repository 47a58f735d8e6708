"""Spark-native analytics over document evidence."""
