"""Spark-native analytics for restriction-site sequencing reads."""
