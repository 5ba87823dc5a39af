"""Operators of a training-data pipeline: search, sharding, filters, models, deduplication, encoding, mixing."""
