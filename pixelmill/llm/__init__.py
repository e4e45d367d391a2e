"""Operators for training-data pipelines: filtering, deduplication, search, packing, archives."""
