"""Spark-native analytics over timed transcripts and chapters."""
