"""Operators for large text corpora: deduplication, tagging, encoding, packing, search."""
