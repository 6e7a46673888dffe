"""Spark-native analytics for price bars, forecasts and their evaluation."""
