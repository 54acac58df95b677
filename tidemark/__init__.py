"""Spark-native analytics for training-data exposure audits."""
