"""Spark-native analytics for ordered trade tapes."""
