"""Spark-native analytics over code-security evidence and other text tables."""
