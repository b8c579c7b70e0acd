"""Spark-native analytics for sampled, time-stamped observations."""
