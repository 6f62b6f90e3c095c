"""Spark-native evaluation analytics engine: cohorts, timelines, answers, metrics."""
