"""Retrieval, conversation analytics and corpus processing on Spark."""
