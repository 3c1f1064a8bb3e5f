"""Spark-native analytics from multilingual documents to regional, topic-level statistics."""
