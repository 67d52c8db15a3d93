"""Tidemark: a Spark-first market-research analytics library."""
