"""Operators for building training data: sampling, duplicates, overlaps, encoding, packing."""
