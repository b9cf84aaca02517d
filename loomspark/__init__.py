"""Loomspark: Spark-native analytics over recorded agent sessions."""
