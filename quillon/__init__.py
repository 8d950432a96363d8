"""Spark-native, point-in-time portfolio analytics."""
