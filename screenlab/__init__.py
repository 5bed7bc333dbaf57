"""Spark-native validation of recognised screen text, and data sets built from it."""
