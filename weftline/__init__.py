"""Spark-native analytics over typed graphs, text corpora and activity logs."""
