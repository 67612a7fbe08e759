"""Spark-native analytics over auditable document corpora."""
