"""Associative retrieval over text corpora on Spark."""
