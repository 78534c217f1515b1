"""Spark-native operators for messy keyed records and usage logs."""
