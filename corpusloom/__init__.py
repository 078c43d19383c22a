"""Spark-native preparation of paired speech-and-text corpora."""
