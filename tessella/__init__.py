"""Spark-native behaviour archive and field analytics engine."""
