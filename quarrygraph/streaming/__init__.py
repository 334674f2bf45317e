"""Incremental maintenance of graph tables."""
