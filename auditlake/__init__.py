"""Spark-native report analytics and audit engine."""
