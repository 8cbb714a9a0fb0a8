"""Spark operators for the data work around ML, retrieval and event systems."""
