"""Spark-native analytics for block-I/O rewrite traces."""
