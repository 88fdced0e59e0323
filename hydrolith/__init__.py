"""Spark-native sensor time-series analytics and training-data operators."""
