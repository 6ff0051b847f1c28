"""Spark-native grid and trace analytics."""
