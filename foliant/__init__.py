"""Spark-first engine for scholarly document processing and analytics."""
