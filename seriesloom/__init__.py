"""Spark-native operators over large collections of time series."""
