"""Brinemark: a Spark-native engine that verifies gridded ocean forecasts."""
