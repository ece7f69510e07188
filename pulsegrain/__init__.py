"""Spark-native analytics for long physiological recordings."""
