"""Spark-native engine for time-series corpora, their evaluation and their preparation."""
