"""Spark-first document conversion and text-quality engine."""
