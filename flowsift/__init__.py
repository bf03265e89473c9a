"""Spark-native network traffic anomaly analytics."""
