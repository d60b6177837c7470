"""Passage search, retrieval evaluation and corpus preparation on Spark."""
