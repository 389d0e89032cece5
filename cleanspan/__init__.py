"""Spark-native text hygiene engine: inspect, clean and explain columns of text."""
