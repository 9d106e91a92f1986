"""Spark-native operators for requirement-to-code verification data."""
