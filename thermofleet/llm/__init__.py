"""Operators of a training-data pipeline: mixing, deduplication, packing, scoring, quality, sharding and search."""
