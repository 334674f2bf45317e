"""Readers that turn inputs into graphs and fact tables."""
