"""Operators for training-data pipelines: fingerprints, deduplication, scans, mixing, packing, search."""
