"""Operators for training-data corpora: search, deduplication, mixing, filters and tokens."""
