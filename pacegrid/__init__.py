"""Spark-native analytics for walkable street networks."""
