"""Semantic-model catalog analytics on Spark."""
