"""Spark-native analytics over agent traces and text corpora."""
