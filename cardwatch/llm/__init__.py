"""Operators of a training-data pipeline: tokens, packing, dedup, quality, sharding, chat formatting."""
