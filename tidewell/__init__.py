"""Spark-native engine for time-ordered sensor data."""
