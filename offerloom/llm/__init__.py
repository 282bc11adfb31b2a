"""Operators for training-data pipelines: deduplication, filtering, mixing, packing and exact vector search."""
