"""Operators for preparing training data: mixing, deduplication, classification, search, archives and packing."""
