"""Spark-native analytics over annotated media batches."""
