"""Spark-native analytics for market time series, social sentiment and training corpora."""
