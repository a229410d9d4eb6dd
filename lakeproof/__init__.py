"""Spark-native analytics for API quality evidence: DataFrame in, DataFrame out."""
