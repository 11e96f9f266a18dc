"""Operators for training-data corpora: near duplicates, secrets, toxicity, sharding, search, extraction, encoding, packing."""
