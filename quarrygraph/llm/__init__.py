"""Training-data operators: filtering, deduplication, scoring and packing of text corpora."""
