"""Spark-native engine for building, checking and scoring multilingual text corpora."""
