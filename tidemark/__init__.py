"""Confidence-aware retrieval and memory on Spark."""
