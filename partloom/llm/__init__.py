"""Operators for training-data corpora: quality, safety, duplicates, packing, extraction."""
