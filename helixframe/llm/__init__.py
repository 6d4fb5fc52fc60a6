"""Operators for preparing training text: tokenising, filtering, fingerprints, dedup, packing, sharding."""
