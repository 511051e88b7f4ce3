"""Spark-native analytics over token-launch events: DataFrame in, DataFrame out."""
