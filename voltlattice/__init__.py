"""Spark-native analytics for networks of capacity-limited charging stations."""
